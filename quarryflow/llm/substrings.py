"""Removal of passages that an earlier document has, by repeated-phrase automata (operator 10).

A window is WINDOW consecutive words. Of its word 6-grams the one with the least hash is its anchor, so equal windows
have equal anchors wherever they stand, and some two positions in nine are anchors. The search goes:

1. anchors that several documents have are found by an aggregation (least and greatest doc_id);
2. around each such anchor, the stretch of words whose windows it anchors is cut out, and equal stretches become one;
3. stretches of the same anchor meet in a shard; windows that documents with different ids have are confirmed there
   word by word, compiled to one Aho-Corasick automaton a shard, and the stretches are streamed through it to locate
   every occurrence, with the least doc_id that has it (a stretch that is its anchor's only one needs no automaton: it
   is the same text wherever the anchor stands, so all its windows recur);
4. each document drops the words of located windows whose least doc_id is smaller than its own.

An anchor with more than HOT distinct stretches (a line that stands in very many places) would load one shard; its
stretches are taken apart into single windows and each window's text is grouped by itself, which pre-aggregates.
Documents with equal words are one class; only the class's smallest doc_id goes through the search, and every later
copy drops all words if it has a window at all.

Defined cases: null and empty texts have no words; texts shorter than a window keep all; rows with a null doc_id take
no part and keep all; rows that share a doc_id do not remove each other's words; repeated rows get the same result;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quarryflow.llm.common import discard, keep, numbered, tidy, words_of
from quarryflow.llm.minhash import mixed

WINDOW = 13
#: Longer grams recur by chance less often, which keeps later steps in proportion; they also make more anchors.
GRAM = 6
HOT = 256
#: Distinct stretches a shard, on average.
SHARD = 4096


def anchors(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: first window of each run, the next run's first, and the anchor's hash."""
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    grams = np.zeros(len(h) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = mixed(grams + h[i : i + len(grams)])
    width = window - GRAM + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = views.argmin(axis=1) + np.arange(len(views))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.append(first[1:], len(views)), grams[at[first]].view(np.int64)


def read_anchors(rows: DataFrame) -> DataFrame:
    """From (row, doc_id, text): row, doc_id, n_words, words (digest) and the distinct anchors of each document."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, digests, found = [], [], []
                for text in part.column("text"):
                    words = words_of(text.as_py())
                    counts.append(len(words))
                    digests.append(blake2b(b" ".join(words), digest_size=16).digest())
                    found.append(np.unique(anchors(words)[2]) if len(words) >= WINDOW else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], names=["row", "doc_id", "n_words", "words", "anchors"])

    return rows.select("row", "doc_id", "text").mapInArrow(read, f"row long, doc_id {kind}, n_words long, words binary, anchors array<long>")


def cut_stretches(rows: DataFrame) -> DataFrame:
    """From (doc_id, row, text, anchors that recur): one row a stretch: anchor, stretch, sid, doc_id, row, start."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, anchor, stretch, start = [], [], [], []
            for i in range(batch.num_rows):
                words = words_of(batch.column("text")[i].as_py())
                first, stop, found = anchors(words)
                for k in np.flatnonzero(np.isin(found, batch.column("recurring")[i].values.to_numpy())):
                    which.append(i)
                    anchor.append(found[k])
                    stretch.append(b" ".join(words[first[k] : stop[k] + WINDOW - 1]))
                    start.append(first[k])
                if len(which) > 20_000 or i == batch.num_rows - 1:
                    sid = np.array([xxh3_64_intdigest(s) for s in stretch], np.uint64).view(np.int64)
                    take = pa.array(which, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor, pa.int64()), pa.array([s.decode() for s in stretch], pa.string()), pa.array(sid), batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(start, pa.int64())],
                        names=["anchor", "stretch", "sid", "doc_id", "row", "start"],
                    )
                    which, anchor, stretch, start = [], [], [], []

    return rows.select("doc_id", "row", "text", "recurring").mapInArrow(cut, f"anchor long, stretch string, sid long, doc_id {kind}, row long, start long")


def locate(frame: pd.DataFrame) -> pd.DataFrame:
    """One shard: compile its recurring windows to an automaton and stream its stretches through it.

    frame: anchor, sid, stretch, least and greatest doc_id. Gives, for each stretch with hits, the windows' offsets
    and the least doc_id of each.
    """
    import ahocorasick

    number: dict[str, int] = {}
    texts = [tuple(number.setdefault(w, len(number)) for w in s.split(" ")) for s in frame["stretch"]]
    seen: dict[tuple, tuple] = {}
    for ids, least, greatest in zip(texts, frame["least"], frame["greatest"], strict=True):
        for i in range(len(ids) - WINDOW + 1):
            window = ids[i : i + WINDOW]
            before = seen.get(window)
            seen[window] = (least, greatest) if before is None else (min(least, before[0]), max(greatest, before[1]))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, (least, greatest) in seen.items():
        if least < greatest:
            automaton.add_word(window, least)
    rows = []
    if len(automaton):
        automaton.make_automaton()
        for anchor, sid, ids in zip(frame["anchor"], frame["sid"], texts, strict=True):
            if hits := list(automaton.iter(ids)):
                rows.append((anchor, sid, [end - WINDOW + 1 for end, _ in hits], [least for _, least in hits]))
    return pd.DataFrame(rows, columns=["anchor", "sid", "at", "least"], dtype=object)


@tidy
def repeated_windows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(row, starts), kept: where windows start that a smaller doc_id has.

    rows: (row, doc_id, text). found: (row, doc_id, anchors) of those whose texts all differ, kept.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    each = found.select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = keep(each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "anchors")
    of_rows = found.select("row", F.explode("anchors").alias("anchor"))
    wanted = keep(of_rows.join(recurring, "anchor", "left_semi").groupBy("row").agg(F.collect_list("anchor").alias("recurring")), "wanted")
    places = keep(cut_stretches(rows.join(wanted, "row")), "places")
    for done in (found, recurring, wanted):
        discard(done)

    stretches = keep(places.groupBy("anchor", "stretch").agg(F.first("sid").alias("sid"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest")), "stretches")
    per_anchor = stretches.groupBy("anchor").agg(F.count("*").alias("n"), F.min("least").alias("a"), F.max("greatest").alias("b"))
    # An anchor whose stretches all come from one doc_id after all (as hashes of several texts) has nothing to find.
    counted = keep(stretches.join(per_anchor.where("a < b").select("anchor", "n"), "anchor"), "counted")
    discard(stretches)
    only, cold, hot = counted.where("n = 1"), counted.where(f"n > 1 AND n <= {HOT}"), counted.where(f"n > {HOT}")

    shards = max(1, -(-cold.count() // SHARD))
    hits = cold.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInPandas(locate, f"anchor long, sid long, at array<int>, least array<{kind}>")
    located = keep(hits.select("anchor", "sid", F.arrays_zip("at", "least").alias("hits")), "hits")

    words = F.split("stretch", " ")
    whole = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(i.cast("int").alias("at"), F.col("least").alias("least")))
    hits = located.union(only.select("anchor", "sid", whole.alias("hits")))
    single = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(i.cast("int").alias("at"), F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("window")))
    apart = keep(hot.select("anchor", "sid", "least", "greatest", F.explode(single).alias("w")).select("anchor", "sid", "least", "greatest", "w.*"), "hot_windows")
    agreed = apart.groupBy("window").agg(F.min("least").alias("_least"), F.max("greatest").alias("_greatest")).where("_least < _greatest")
    hot_hits = apart.join(agreed, "window").groupBy("anchor", "sid").agg(F.collect_list(F.struct("at", F.col("_least").alias("least"))).alias("hits"))

    found = places.select("anchor", "sid", "doc_id", "row", "start").join(hits.union(hot_hits), ["anchor", "sid"])
    starts = F.transform(F.filter("hits", lambda h: h["least"] < F.col("doc_id")), lambda h: F.col("start") + h["at"])
    starts = found.select("row", starts.alias("starts")).where(F.size("starts") > 0).groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return keep(starts, "starts")


@tidy
def removed_windows(rows: DataFrame) -> DataFrame:
    """row, starts and copy of each of rows (row, doc_id, text), kept: where removed windows start, or that all words go."""
    read = keep(read_anchors(rows), "read")
    classes = read.where("doc_id IS NOT NULL").where(F.col("n_words") >= WINDOW).groupBy("words").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = keep(classes.select("words", F.col("first.doc_id").alias("_doc_id"), F.col("first.row").alias("_row")), "classes")
    ids = keep(read.select("row", "doc_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW), F.col("words")).alias("words")), "ids")
    found = keep(read.select("row", "doc_id", "anchors").join(classes, F.col("row") == F.col("_row"), "left_semi"), "found")
    discard(read)
    starts = repeated_windows(rows, found)
    named = keep(classes.join(starts, F.col("_row") == F.col("row"), "left").select("words", "_doc_id", "starts"), "named")
    out = ids.join(named, "words", "left")
    return keep(out.select("row", "starts", F.coalesce(F.col("doc_id") > F.col("_doc_id"), F.lit(False)).alias("copy")), "removed")


def drop_repeated_passages(docs: DataFrame, stored: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and kept_text, the kept words joined by one space."""
    numbers = numbered(docs, stored)
    rows = numbers.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = rows.join(removed_windows(rows), "row").select("doc_id", "text", "starts", "copy")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_words, n_removed, texts = [], [], []
                for text, starts, copy in zip(*(part.column(c) for c in ("text", "starts", "copy")), strict=True):
                    words = words_of(text.as_py())
                    n_words.append(len(words))
                    kept = [] if copy.as_py() else words
                    if starts.is_valid and not copy.as_py():
                        edge = np.zeros(len(words) + 1, np.int64)
                        first = np.unique(starts.values.to_numpy())
                        np.add.at(edge, first, 1)
                        np.add.at(edge, first + WINDOW, -1)
                        kept = [words[i] for i in np.flatnonzero(edge.cumsum()[:-1] == 0)]
                    n_removed.append(len(words) - len(kept))
                    texts.append(b" ".join(kept).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return whole.mapInArrow(drop, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def oracle_sql() -> str:
    """n_words, n_removed and the digest of the kept text in DuckDB SQL; every window is a row there."""
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, ws, UNNEST(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
first AS (SELECT s, MIN(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i FROM win JOIN first USING (s) WHERE m < doc_id), (SELECT UNNEST(range({WINDOW})) AS k)),
words AS (SELECT doc_id, UNNEST(ws) AS x, UNNEST(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, COUNT(*) AS n, STRING_AGG(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - COALESCE(n, 0) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""
