"""Cross-tokenizer alignment (operator 11).

Two tokenizers cut the same bytes, a space and the text, at different places. The union of both sets of token ends cuts
the bytes into elementary intervals; a binary search in each set of ends names the two tokens that own an interval, and
that is one overlap. An end that both tokenizers share closes a group, and all pairs of A and B tokens of one group are
links. How many documents hold a pair of ids linked is counted over the corpus, and each document's links are weighed
by those counts.

Neither tokenizer joins what lies before a space or a line end with what follows (the vocabulary is looked at for that;
otherwise a text is one chunk), so texts are cut there into chunks that share their ends, and workers remember the
alignment of recent chunks. A document then is a multiset of chunks.

The counts of all pairs can be many, so they are joined with the documents in two parts: the most frequent pairs, at
most HOT, by broadcast, all others by a shuffle. That changes the plan only.

Defined cases: texts that are null, empty, or whose joined bytes differ from space and text under either tokenizer have
no tokens: zeros, and an empty string of groups; repeated rows are documents of their own; a null doc_id is kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryflow.llm.common import keep, tidy

#: Pairs of ids whose counts are broadcast, at most.
HOT = 1 << 19
#: Chunks and their characters that a worker remembers, and characters of texts that are read at once.
REMEMBERED, REMEMBERED_CHARS, BATCH_CHARS = 600_000, 10_000_000, 1_000_000
#: Links that are written out at once; a larger group is multiplied by its distinct ids.
EXPANDED = 1 << 20

_CHUNK = re.compile(r"[ \n]\s*\S*")
_CHUNK_OF_BLANKS = re.compile(r"[ \n]\s*+(?:\S++[^\S \n]\s*+)*+\S*+")
_OTHER_BLANK = re.compile(r"[^\S \n]")
#: A token that goes on behind such a cut.
_JOINED = re.compile(r"\S[ \n]")


def chunks(text: str) -> list[str]:
    """A space and the text, cut before each space or line end that follows no other blank."""
    return (_CHUNK_OF_BLANKS if _OTHER_BLANK.search(text) else _CHUNK).findall(" " + text)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin ones themselves, the others 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the alignment of the chunks met so far."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.blank = self.b.piece_to_id("▁")
        self.span = len(self.b_bytes)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.whole = any(_JOINED.search(x.decode("utf-8", "replace")) for x in self.a_bytes + self.b_bytes)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.groups: list[str] = []
        self.figures = np.zeros((0, 5), np.int64)  # fits, A tokens, B tokens, groups, links
        self.starts, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokens(self, found: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of both tokenizers for each chunk; none where the bytes don't come back."""
        mine = [e.ids for e in self.a.encode_batch(found, add_special_tokens=False)]
        theirs = self.b.encode([c[1:] if c.startswith(" ") else c for c in found], num_threads=1)
        out = []
        for c, one, two in zip(found, mine, theirs, strict=True):
            if not c.startswith(" "):  # the tokenizer put a space before it
                two = two[1:] if two and two[0] == self.blank else []
            elif c == " ":  # an empty text has no tokens
                two = [self.blank]
            data = c.encode()
            fits = b"".join([self.a_bytes[i] for i in one]) == data and b"".join([self.b_bytes[i] for i in two]) == data
            out.append((one, two) if fits else ([], []))
        return out

    def learn(self, found: list[str]) -> None:
        known = self.tokens(found)
        counts = np.array([(bool(a), len(a), len(b)) for a, b in known], np.int64)
        one, two = (np.fromiter(chain.from_iterable(x[k] for x in known), np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.a_sizes[one]), np.cumsum(self.b_sizes[two])
        # elementary intervals, each with the two tokens that own it
        ends = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        closes = np.flatnonzero((ends_a[own_a] == ends) & (ends_b[own_b] == ends)) if len(ends) else np.zeros(0, np.int64)
        to_a, to_b = own_a[closes] + 1, own_b[closes] + 1
        from_a, from_b = (np.concatenate(([0], t[:-1])) if len(t) else t for t in (to_a, to_b))
        links = (to_a - from_a) * (to_b - from_b)
        chunk_of = np.repeat(np.arange(len(known)), counts[:, 1])[from_a] if len(from_a) else from_a
        of, pairs, times = self.products(one, two, from_a, to_a, from_b, to_b, links, chunk_of)
        figures = np.zeros((len(known), 5), np.int64)
        figures[:, :3] = counts
        figures[:, 3] = np.bincount(chunk_of, minlength=len(known))
        np.add.at(figures[:, 4], chunk_of, links)
        ids_a, ids_b = list(map(str, one.tolist())), list(map(str, two.tolist()))
        texts = [f"{','.join(ids_a[i:j])}|{','.join(ids_b[k:m])}" for i, j, k, m in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True)]
        at = np.concatenate(([0], np.cumsum(figures[:, 3]))).tolist()
        first = len(self.groups)
        self.index.update(zip(found, range(first, first + len(found))))
        self.held += sum(map(len, found))
        self.groups += [";".join(texts[i:j]) for i, j in zip(at, at[1:])]
        self.figures = np.concatenate((self.figures, figures))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.bincount(of, minlength=len(found)))))
        self.pairs, self.times = np.concatenate((self.pairs, pairs)), np.concatenate((self.times, times))

    def products(self, one, two, from_a, to_a, from_b, to_b, links, chunk_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, pair, times), by chunk: the distinct pairs of ids linked in each chunk and their links."""
        parts, large = [], links > EXPANDED
        small = np.flatnonzero(~large)
        lots = np.concatenate(([0], np.cumsum(links[small])))
        at = 0
        while at < len(small):
            stop = max(at + 1, int(np.searchsorted(lots, lots[at] + EXPANDED, side="right")) - 1)
            g = small[at:stop]
            n, wide = links[g], (to_b - from_b)[g]
            which = np.repeat(np.arange(len(g)), n)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            pair = one[from_a[g][which] + turn // wide[which]] * self.span + two[from_b[g][which] + turn % wide[which]]
            parts.append(_counted(chunk_of[g][which], pair, np.ones(len(pair), np.int64)))
            at = stop
        for g in np.flatnonzero(large):
            (x, n), (y, m) = (np.unique(t[i:j], return_counts=True) for t, i, j in ((one, from_a[g], to_a[g]), (two, from_b[g], to_b[g])))
            pair = (x[:, None] * self.span + y[None, :]).ravel()
            parts.append((np.full(len(pair), chunk_of[g]), pair, (n[:, None] * m[None, :]).ravel()))
        return _counted(*(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)))

    def read(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Figures (A tokens, B tokens, groups, links) and digest of groups of each text; its (text, pair, times)."""
        if len(self.index) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.forget()
        cut = [chunks(t) if t and not self.whole else [" " + t] if t else [] for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        flat = list(chain.from_iterable(cut))
        if missing := [c for c in dict.fromkeys(flat) if c not in self.index]:
            self.learn(missing)
        codes = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        stops = np.cumsum(counts)
        total = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(self.figures[codes], axis=0)))
        figures = total[stops] - total[stops - counts]
        fits = (figures[:, 0] == counts) & (counts > 0)
        digests = [sha256(";".join([self.groups[c] for c in codes[e - n : e].tolist()]).encode()).hexdigest() if ok else "" for e, n, ok in zip(stops.tolist(), counts.tolist(), fits.tolist(), strict=True)]
        of = np.repeat(np.arange(len(texts)), counts)
        good = fits[of]
        of, code, repeats = _counted(of[good], codes[good], None)
        sizes = self.starts[code + 1] - self.starts[code]
        which = np.repeat(np.arange(len(code)), sizes)
        at = self.starts[code][which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return figures[:, 1:] * fits[:, None], digests, *_counted(of[which], self.pairs[at], self.times[at] * repeats[which])


def _counted(of: np.ndarray, value: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (of, value) in order, and the sum of times (None: of ones) of each. Values are below 2 ** 40."""
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(of) < 1 << 23 and value.max() < 1 << 40:
        key = of << 40 | value
        order = np.argsort(key)
    else:
        order = np.lexsort((value, of))
    of, value = of[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (value[1:] != value[:-1]))))
    sums = np.diff(np.append(first, len(of))) if times is None else np.add.reduceat(times[order], first)
    return of[first], value[first], sums


@lru_cache(1)
def _aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


_LINKS = pa.struct([("pair", pa.int64()), ("times", pa.int64())])


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links, array of (pair = A id * vocabulary of B + B id, times)."""

    def described(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        figures, digests, of, pair, times = _aligner(byte_level, pieces).read(texts)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))
        links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], fields=list(_LINKS)))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(figures[:, k]) for k in range(4)), pa.array(digests, pa.string()), links], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, first = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > BATCH_CHARS:
                    yield described(batch.column("doc_id").slice(first, len(texts)), texts)
                    texts, held, first = [], 0, i + 1
            if texts:
                yield described(batch.column("doc_id").slice(first, len(texts)), texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: long>>"
    )


@tidy
def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """aligned() without links, with n_best and count_sum; kept.

    n_best: links whose pair is held by as many documents as any pair with the same A id. count_sum: the sum of those
    counts over all links.
    """
    import sentencepiece

    span = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    rows = keep(aligned(docs, byte_level, pieces).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = keep(rows.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    a_id = F.expr(f"pair div {span}")
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # one row an id of A's vocabulary
    counts = keep(counts.withColumn("a", a_id).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "weighed")
    least = _frequent(counts)
    hot, cold = F.broadcast(counts.where(F.col("n") >= least)), counts.where(F.col("n") < least)
    linked = rows.select("row", F.inline("links"))
    rare = linked.join(F.broadcast(counts.where(F.col("n") >= least).select("pair")), "pair", "left_anti").join(cold, "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = [part.groupBy("row").agg(*sums) for part in (linked.join(hot, "pair"), rare)]
    total = parts[0].union(parts[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    figures = rows.drop("links").join(total, "row", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keep(figures.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256"), "alignment")


def _frequent(counts: DataFrame) -> int:
    """The least power of two that at most HOT counts reach; read from one row a power."""
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect()
    held, least = 0, 1 << 62
    for r in powers:
        held += r["n"]
        if held > HOT:
            break
        least = 1 << r["power"]
    return least
