"""Quality classifier: a generalised additive model with pairwise interactions (operator 4).

Features come from the whole text alone. Cyclic boosting visits one feature after another and adds a shallow tree on
that feature's bins; then the strongest pairs get small trees over two features. What was learnt is one lookup table a
feature and one a pair, so scoring is binning and additions.

The model is fitted on a bounded sample (sample_rows) of the labelled documents outside the held-out fold, taken in the
order of a hash of the doc_id. The sample is all that reaches the driver.

Defined cases: null text scores as empty text; null doc_ids are scored, are not held out and never train; labels that
are null are left out and several labels of a document become their mean, 1 from 0.5; without labels, or with labels
of one kind only, every score is the smoothed share of label 1 (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryflow.llm.common import text_bytes

SAMPLE_ROWS = 20_000
BINS = 48
PAIR_BINS = 8
PAIRS = 6

#: Byte classes, one count each.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?", b"!", b"|", b"#$%&*+<=>@[\\]^_`{}~/", b"'\"()-", b" \t\n\r")
FEATURES = ("log_bytes", "log_words", "bytes_a_word", "upper", "lower", "digit", "stop", "bang", "pipe", "symbol", "quote", "blank", "upper_of_letters", "distinct_words", "root_distinct", "longest_word", "log_lines", "bytes_a_line", "repeated_lines", "packed", "stops_a_word")
_CLASS_OF = np.zeros((256, len(CLASSES)))
for _k, _members in enumerate(CLASSES):
    _CLASS_OF[list(_members), _k] = 1


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        raw = text_bytes(text)
        words, lines, n = raw.split(), [x for x in raw.split(b"\n") if x], max(1, len(raw))
        upper, lower, digit, stop, bang, pipe, symbol, quote, blank = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF
        kinds, w = len(set(words)), max(1, len(words))
        row[:] = (
            np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w,
            upper / n, lower / n, digit / n, stop / n, bang / n, pipe / n, symbol / n, quote / n, blank / n,
            upper / max(1, upper + lower), kinds / w, kinds / w**0.5, max(map(len, words), default=0),
            np.log1p(len(lines)), len(raw) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
            len(zlib.compress(raw, 1)) / n, stop / w,
        )
    return out


@dataclass
class AdditiveModel:
    """Intercept, bin edges and table by feature, and pairs with their coarse edges and tables."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        if self.pairs:
            bins = coarse_bins(self.coarse, x)
            for f, g, table in self.pairs:
                total += table[bins[:, f], bins[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def coarse_bins(coarse: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)], axis=1) if len(x) else np.zeros((0, len(coarse)), int)


def quantile_edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def step_tree(g: np.ndarray, h: np.ndarray, leaf_weight: float = 1.0) -> np.ndarray:
    """The best two-cut (three-leaf) tree on ordered bins, grown cut by cut; the Newton value of each bin's leaf."""
    cuts: list[int] = []
    for _ in range(2):
        best, at = 0.0, None
        for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + leaf_weight) + (gt - gl) ** 2 / (ht - hl + leaf_weight) - gt**2 / (ht + leaf_weight)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-12:
                best, at = gain[k], a + k + 1
        if at is None:
            break
        cuts = sorted([*cuts, at])
    value = np.zeros(len(g))
    for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True):
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + leaf_weight)
    return value


def cross_tree(g: np.ndarray, h: np.ndarray, leaf_weight: float = 1.0) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features (four leaves): its gain and each cell's Newton value."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = [(c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]) for c in (cg, ch)]
    gain = sum(a**2 / (b + leaf_weight) for a, b in zip(*parts, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.zeros_like(g)
    cells = (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])
    for cell in cells:
        value[cell] = g[cell].sum() / (h[cell].sum() + leaf_weight)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + leaf_weight)), value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> AdditiveModel:
    """Cyclic boosting of the logistic loss, features first, then the strongest pairs on what is left."""
    n = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))), [np.zeros(0)] * n, [np.zeros(1)] * n, [np.zeros(0)] * n, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [quantile_edges(x[:, f], BINS) for f in range(n)]
    model.coarse = [quantile_edges(x[:, f], PAIR_BINS) for f in range(n)]
    bins = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f in range(n):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            value = rate * step_tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size))
            model.tables[f] += value
            total += value[bins[f]]
    small = coarse_bins(model.coarse, x)

    def grid(f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)
        flat, p = small[:, f] * shape[1] + small[:, g], 1 / (1 + np.exp(-total))
        return flat, np.bincount(flat, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(flat, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    strength = sorted(((cross_tree(*grid(f, g)[1:])[0], f, g) for f, g in combinations(range(n), 2)), reverse=True)[:PAIRS]
    model.pairs = [(f, g, np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1))) for _, f, g in strength]
    for _ in range(pair_rounds):
        for f, g, table in model.pairs:
            flat, grad, hess = grid(f, g)
            value = rate * cross_tree(grad, hess)[1]
            table += value
            total += value.reshape(-1)[flat]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that never trains: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most sample_rows labelled documents outside the held-out fold."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": list(features(frame["text"].tolist())), "y": frame["_label"]})

    measured = rows.mapInPandas(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>, y int")
    #: Repeated rows of a labelled document could pass the bound; the limit holds it.
    sample = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample_rows).toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), len(FEATURES))
    return fit(x, sample["y"].to_numpy(float))


def quality_score(model: AdditiveModel, text: str = "text") -> Column:
    """The score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(features(texts.tolist())))

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels, sample_rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return docs.where(quality_score(fit_quality(docs, labels, sample_rows)) >= 0.5)
