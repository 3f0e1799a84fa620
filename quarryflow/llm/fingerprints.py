"""Document fingerprints by randomised edit embedding (operator 7).

A pointer walks over a text's characters. At each step it writes down the character it stands on, and a random bit that
depends on the step and on that character says whether it moves on. The bits are shared by all texts, so after an
insertion or deletion the walks over two texts soon fall into step again, and a small edit distance becomes a small
Hamming distance between what was written. The walk starts anew at every SEGMENT characters, with the same bits, so a
long text is many short walks that run side by side.

A fingerprint samples fixed steps of each walk, more densely near its start (each of the first 16 steps, which tells
the shortest texts apart), as one hexadecimal digit each, and "-" where the walk has run off the text. Likeness of two
fingerprints is the share of agreeing samples, each weighing as many steps as it stands for. Bands of samples within a
segment bring similar documents together; likeness confirms.

Defined cases: null text counts as empty; an empty text has an empty fingerprint; two empty fingerprints have likeness
1, an empty and another one 0; doc_ids are whole numbers; null ones come before all others; rows with equal doc_ids
follow each other in one fixed order of their texts (that of the compressed bytes);
an only document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.llm.common import keep, small
from quarryflow.llm.components import Dense, crowds, linked_within_buckets, with_contents
from quarryflow.llm.minhash import mixed

SEGMENT = 2048
STEPS = 3 * SEGMENT
#: Steps of a walk, and how many samples are taken of them.
STRATA = ((0, 96, 16), (96, 384, 16), (384, 1536, 24), (1536, STEPS, 40))
#: Each of the first steps is a sample as well.
EVERY = 16
#: Bands of a text of one segment, and samples a band.
BANDS, BAND_SAMPLES = 28, 8
#: A segment shorter than this share of the next size class's least length has no alike segment there.
NEAR_BORDER = 0.7
#: Documents in one range of doc_ids, on average, and the most ranges.
RANGE, RANGES = 1024, 8192

_random = np.random.default_rng(7)
_MOVES = _random.integers(0, 2, (STEPS, 256), dtype=np.uint8)
_MOVES[:, 0] = 0
_AT = np.concatenate([np.sort(_random.choice(np.arange(a, b), n, replace=False)) for a, b, n in STRATA])
_DRAWN = _AT
_AT = np.union1d(np.arange(EVERY), _AT)
#: Bands are made of the drawn samples only; neighbouring steps mostly stand on one character.
_BANDED = np.isin(_AT, _DRAWN)
SAMPLES = len(_AT)
_EDGES = np.array([0, EVERY, *(b for _, b, _ in STRATA)])
_OF = np.searchsorted(_EDGES, _AT, side="right") - 1
#: Steps that a sample stands for, as whole numbers of one common unit, so that likeness is exact.
_UNIT = int(np.lcm.reduce(np.bincount(_OF)))
_WEIGHT = np.diff(_EDGES)[_OF] * (_UNIT // np.bincount(_OF)[_OF])
_DIGIT = _random.choice(np.frombuffer(b"0123456789abcdef", np.uint8), (SAMPLES, 256))
_DIGIT[:, 0] = ord("-")


@lru_cache(32)
def band_samples(size_class: int) -> np.ndarray:
    """(bands, samples): the bands of a walk over about 2 ** (size_class / 2) characters, drawn from what lies past its start.

    Texts often begin alike; samples from the middle tell more. A sample is drawn with the weight that it has in the
    likeness, so it agrees with about that probability. Of few samples, bands take half.
    """
    size = 2 ** (size_class / 2)
    eligible = np.flatnonzero(_BANDED & (_AT >= size / 4) & (_AT < 1.6 * size))
    if len(eligible) < 5:
        eligible = np.flatnonzero(_BANDED & (_AT < max(24, 2 * size)))
    width = min(BAND_SAMPLES, max(1, len(eligible) // 2))
    if not len(eligible):
        return np.zeros((0, width), np.int64)
    pick, weight = np.random.default_rng([7, size_class]), _WEIGHT[eligible]
    bands = [tuple(sorted(pick.choice(eligible, width, replace=False, p=weight / weight.sum()).tolist())) for _ in range(BANDS)]
    return np.array(list(dict.fromkeys(bands)), np.int64)


@lru_cache(1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def fingerprints(texts: list[str]) -> list[bytes]:
    """The fingerprints of whole texts."""
    codes, counts = [], []
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        codes.append((((points * np.uint32(2654435761)) >> np.uint32(17)) % np.uint32(255) + np.uint32(1)).astype(np.uint8))
        counts.append(-(-len(points) // SEGMENT))
    n = sum(counts)
    if n == 0:
        return [b""] * len(texts)
    field, row = np.zeros((n, SEGMENT + 1), np.uint8), 0
    for code, count in zip(codes, counts, strict=True):
        whole = len(code) // SEGMENT
        field[row : row + whole, :SEGMENT] = code[: whole * SEGMENT].reshape(whole, SEGMENT)
        if count > whole:
            field[row + whole, : len(code) - whole * SEGMENT] = code[whole * SEGMENT :]
        row += count
    flat, place = field.ravel(), np.arange(n, dtype=np.int64) * (SEGMENT + 1)
    here, move, taken = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros((SAMPLES, n), np.uint8)
    wanted = {int(step): k for k, step in enumerate(_AT)}
    for step in range(int(_AT[-1]) + 1):
        np.take(flat, place, out=here, mode="clip")
        if step % 64 == 0 and not here.any():  # every walk has run off its text, whatever else is in the batch
            break
        if step in wanted:
            taken[wanted[step]] = here
        np.take(_MOVES[step], here, out=move, mode="clip")
        place += move
    digits = np.take_along_axis(_DIGIT, taken, axis=1).T
    ends = np.cumsum([0, *counts])
    return [digits[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def _agreement(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the samples that agree and weight of those that either reaches, by segment: arrays (..., SAMPLES)."""
    reached = (one != ord("-")) | (two != ord("-"))
    return ((one == two) & reached) @ _WEIGHT, reached @ _WEIGHT


def likenesses(ones: list[bytes], twos: list[bytes]) -> np.ndarray:
    """Share of agreeing samples, by weight, of those that either text reaches, for each pair of fingerprints."""
    sizes = [max(len(a), len(b)) for a, b in zip(ones, twos, strict=True)]
    grids = (np.frombuffer(b"".join(p.ljust(n, b"-") for p, n in zip(prints, sizes, strict=True)), np.uint8).reshape(-1, SAMPLES) for prints in (ones, twos))
    ends = np.cumsum([0, *sizes]) // SAMPLES
    agree, reached = (np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in _agreement(*grids))
    same = np.array([a == b for a, b in zip(ones, twos, strict=True)], bool)
    return np.where(reached > 0, agree / np.maximum(reached, 1), same.astype(float))


def likeness(one: bytes, two: bytes) -> float:
    return float(likenesses([one], [two])[0])


def reach(prints: list[bytes]) -> np.ndarray:
    """Steps that each fingerprint's samples stand for, rounded down. Likeness is at most the ratio of two of them."""
    return np.array([int(((np.frombuffer(p, np.uint8).reshape(-1, SAMPLES) != ord("-")) @ _WEIGHT).sum()) // _UNIT for p in prints], np.int64)


def alike_matrix(some: list[bytes], others: list[bytes], least: float) -> np.ndarray:
    """Which of all pairs have at least this likeness."""
    out = np.zeros((len(some), len(others)), bool)
    wide = max(map(len, others), default=0)
    grid = np.frombuffer(b"".join(p.ljust(wide, b"-") for p in others), np.uint8).reshape(len(others), -1, SAMPLES) if wide else None
    mine, theirs = reach(some), reach(others)
    for i, p in enumerate(some):
        fit = np.flatnonzero(np.minimum(mine[i], theirs) + 1 >= least * np.maximum(mine[i], theirs))
        if wide and p and len(fit):
            segments = max(len(p), max(len(others[j]) for j in fit.tolist())) // SAMPLES
            own = np.frombuffer(p.ljust(segments * SAMPLES, b"-"), np.uint8).reshape(segments, SAMPLES)
            held = grid[fit, :segments]
            if held.shape[1] < segments:  # all others are shorter
                held = np.pad(held, ((0, 0), (0, segments - held.shape[1]), (0, 0)), constant_values=ord("-"))
            agree, reached = _agreement(own[None], held)
            agree, reached = agree.sum(axis=1), reached.sum(axis=1)
            out[i, fit] = np.where(reached > 0, agree >= least * reached, [p == others[j] for j in fit.tolist()])
    return out


def band_keys(prints: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text): the keys of each text's bands and the number of their text.

    A segment has the bands of its own size class and, from NEAR_BORDER of the next one's least length on, of that as
    well, so alike texts on both sides of a border share some. The more segments a text has, the fewer bands has each:
    2 / (segments + 1) of BANDS, always the first ones, so a text has BANDS to twice as many. The segments of a text
    agree by different shares; the best of them make up for fewer bands.
    """
    grid = np.frombuffer(b"".join(prints), np.uint8).reshape(-1, SAMPLES)
    counts = np.array([len(p) // SAMPLES for p in prints], np.int64)
    text = np.repeat(np.arange(len(prints)), counts)
    segment = np.arange(len(grid)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(SEGMENT, n_chars[text] - segment * SEGMENT)
    size_class = (2 * np.log2(length)).astype(np.int64)
    bordering = length >= NEAR_BORDER * 2 ** ((size_class + 1) / 2)
    allowed = np.ceil(2 * BANDS / (counts[text] + 1)).astype(np.int64)
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for c in range(int(2 * np.log2(SEGMENT)) + 1):
        rows = np.flatnonzero((size_class == c) | (size_class == c - 1) & bordering)  # alike texts are at most a class apart
        samples = band_samples(int(c))
        digits, packed = grid[rows][:, samples].astype(np.uint64), np.zeros((len(rows), len(samples)), np.uint64)
        for k in range(samples.shape[1]):
            packed = packed << np.uint64(8) | digits[:, :, k]
        salt = (segment[rows][:, None] * 64 + c) * 256 + np.arange(len(samples))[None, :]
        own = np.arange(len(samples))[None, :] < allowed[rows][:, None]
        keys.append(mixed(packed ^ mixed(salt.astype(np.uint64)))[own])
        of.append(np.repeat(text[rows], own.sum(axis=1)))
    return np.concatenate(keys).view(np.int64), np.concatenate(of)


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, node, size): one row for each key of each class, size is its reach. classes: (row, n_chars, fingerprint)."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = [p.encode() for p in part.column("fingerprint").to_pylist()]
                keys, of = band_keys(prints, part.column("n_chars").to_numpy())
                node = part.column("row").to_numpy()[of]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(reach(prints)[of])], names=["bucket", "node", "size"])

    return classes.select("row", "n_chars", "fingerprint").mapInArrow(band, "bucket long, node long, size long")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _described(doc_ids: list, texts: list[str], prints: list[bytes], nexts: list[tuple[str, bytes]]) -> list[tuple]:
    changed = [edited(text, following) for text, (following, _) in zip(texts, nexts, strict=True)]
    others = fingerprints(changed)
    to_edited, to_next = likenesses(prints, others).tolist(), likenesses(prints, [q for _, q in nexts]).tolist()
    return [
        (d, len(t), sha256(c.encode("utf-8", "replace")).hexdigest(), p.decode(), o.decode(), e, n, blake2b(p, digest_size=16).digest() if p else None)
        for d, t, c, p, o, e, n in zip(doc_ids, texts, changed, prints, others, to_edited, to_next, strict=True)
    ]


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("same", pa.binary())]
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same binary"
_EDGE = [("kind", pa.int32()), ("range", pa.int32()), ("packed", pa.binary())]
_EDGE_SCHEMA = "kind int, range int, packed binary"


def _batch(doc_id_type: pa.DataType, rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    """rows as _described gives; edges: (kind, range, packed) of each."""
    names = ["doc_id", *(n for n, _ in _FIELDS), *(n for n, _ in _EDGE)]
    kinds = [doc_id_type, *(t for _, t in _FIELDS), *(t for _, t in _EDGE)]
    columns = list(zip(*(r + e for r, e in zip(rows, edges, strict=True)), strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def describe(docs: DataFrame, chunk: int = 512) -> DataFrame:
    """One row a document, kept: row (a number), doc_id, n_chars, edited_sha256, both fingerprints, both likenesses, same (digest).

    Documents are dealt by ranges of doc_ids and sorted within each, so almost every next document is the next row.
    The first and the last of each range are written as well, and the few pairs across ranges are joined after. A task
    reads its range as a stream, chunk by chunk, so beyond RANGES * RANGE documents tasks get longer, not larger.
    """
    n = docs.count()
    ranges = max(1, min(RANGES, -(-n // RANGE)))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares).alias("b")).head()["b"] if shares and n else []
    edges = np.unique(np.array([b for b in bounds or []], np.int64))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _zstd()[0].compress
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            of = [0 if d is None else int(np.searchsorted(edges, d, side="right")) for d in ids]
            packed = [compress((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(of, pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "range", "packed"])

    dealt = docs.select("doc_id", "text").mapInArrow(pack, f"doc_id {kind}, range int, packed binary")
    dealt = dealt.repartition(ranges, "range").sortWithinPartitions("range", "doc_id", "packed")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _zstd()[1].decompress
        before = None  # (range, doc_id, packed, text, fingerprint) of the row before
        doc_id_type = None
        for batch in batches:
            doc_id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                packed = part.column("packed").to_pylist()
                texts = [unpack(p).decode() for p in packed]
                rows = list(zip(part.column("range").to_pylist(), part.column("doc_id").to_pylist(), packed, texts, fingerprints(texts), strict=True))
                line = [before, *rows] if before else rows
                pairs = [(a, b) for a, b in zip(line, line[1:]) if a[0] == b[0]]
                done = _described([a[1] for a, _ in pairs], [a[3] for a, _ in pairs], [a[4] for a, _ in pairs], [(b[3], b[4]) for _, b in pairs])
                yield _batch(doc_id_type, done, [(0, None, None)] * len(done))
                cuts = [(a, b) for a, b in zip(line, line[1:]) if a[0] != b[0]] + ([(None, rows[0])] if not before else [])
                ends = [(2, a) for a, _ in cuts if a] + [(1, b) for _, b in cuts]
                yield _batch(doc_id_type, [(r[1], None, None, r[4].decode(), None, None, None, None) for _, r in ends], [(k, r[0], r[2]) for k, r in ends])
                before = rows[-1]
        if before:
            yield _batch(doc_id_type, [(before[1], None, None, before[4].decode(), None, None, None, None)], [(2, before[0], before[2])])

    walked = dealt.mapInArrow(walk, f"doc_id {kind}, {_SCHEMA}, {_EDGE_SCHEMA}")
    walked = keep(walked.withColumn("row", F.monotonically_increasing_id()), "walked")
    heads = walked.where("kind = 1").select("range", F.col("packed").alias("next_packed"), F.col("fingerprint").alias("next_fingerprint"))
    tails = walked.where("kind = 2").select("range", "doc_id", "packed", "fingerprint")
    order = walked.where("kind = 1").select("range")  # one row a range, RANGES at most
    order = order.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy(F.lit(0)))).alias("_next"))
    closing = tails.join(small(order), "range").join(heads.withColumnRenamed("range", "_next"), "_next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _zstd()[1].decompress
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            texts, nexts = ([unpack(p).decode() for p in c[name]] for name in ("packed", "next_packed"))
            prints, others = ([p.encode() for p in c[name]] for name in ("fingerprint", "next_fingerprint"))
            rows = _described(c["doc_id"], texts, prints, list(zip(nexts, others, strict=True)))
            yield _batch(batch.schema.field("doc_id").type, rows, [(0, r, None) for r in c["range"]])

    closed = closing.mapInArrow(close, f"doc_id {kind}, {_SCHEMA}, {_EDGE_SCHEMA}")
    closed = keep(closed.withColumn("row", -1 - F.col("range").cast("long")), "closed")
    return walked.where("kind = 0").union(closed).drop("kind", "range", "packed")


def alike_pairs(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints have at least this likeness. prints: (node, content)."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("content_a", "content_b"))
            good = pa.array(likenesses([p.encode() for p in one], [p.encode() for p in two]) >= least)
            yield batch.select(["a", "b"]).filter(good)

    return with_contents(pairs, prints).mapInArrow(confirm, "a long, b long")


def fingerprint_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """describe(), and class_id: the smallest doc_id of the documents linked by likeness of at least least."""
    rows = describe(docs)
    linkable = rows.where("same IS NOT NULL AND doc_id IS NOT NULL")
    classes = linkable.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("fingerprint").alias("fingerprint"), F.min("n_chars").alias("n_chars"))
    classes = keep(classes.select("same", F.col("first.doc_id").alias("_doc_id"), F.col("first.row").alias("row"), "fingerprint", "n_chars"), "classes")
    shared = crowds(banded(classes))
    prints = classes.select(F.col("row").alias("node"), F.col("fingerprint").alias("content"))
    fits = lambda a, b: F.least(a, b) + 1 >= F.lit(least) * F.greatest(a, b)
    dense = Dense(prints, str.encode, lambda one, two: likeness(one, two) >= least, 64, 256, 1024, merge=False, sieve=lambda some, others: alike_matrix(some, others, least))
    roots = linked_within_buckets(shared, lambda pairs: alike_pairs(pairs, prints, least), fits, dense)
    named = classes.select("same", "_doc_id", "row").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    least_id = named.groupBy("root").agg(F.min("_doc_id").alias("class_id"))
    groups = keep(named.join(least_id, "root").select("same", "class_id"), "groups")
    linked = rows.withColumn("same", F.when(F.col("doc_id").isNotNull(), F.col("same"))).drop("row")
    return linked.join(groups, "same", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")).drop("same")
