"""Best-fit packing of token sequences, improved by a swap-based local search (operator 8).

Every document becomes its token ids and one closing id. Documents longer than a sequence are cut into full pieces;
nothing else is cut. Pieces are dealt at random into lots of a few thousand; each lot is packed on its own, so no task
holds more than one lot and the loss against one global packing is at most about one bin a lot.

Defined cases: a null or empty text is the closing id alone; a null doc_id stays null; repeated rows are packed each on
their own; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryflow.llm.common import keep

CAPACITY = 2048
#: Pieces a lot, on average.
LOT = 8192
#: Chunks, and lower-case words, that a Python worker remembers with their ids.
REMEMBERED = 450_000
#: Latin words, whose lower case is the same by all rules, with a few ASCII marks behind, which are a pre-token of their own.
PLAIN = re.compile(r"^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-/:-@\[-`{-~]{0,3})$", re.M)


class ChunkTokenizer:
    """Token ids of whole texts, remembered by blank-separated chunk and by lower-case word.

    The vocabulary drops white space and case and never joins across blanks, so a text's ids are its chunks' ids in
    order. A word of letters alone is one pre-token; many of them are encoded in one string and told apart by the
    end-of-word mark. Everything else is encoded chunk by chunk.
    """

    def __init__(self, path: str, closing_id: int = 0):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        vocab = self.encoder.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.closing = np.array([closing_id], "<u4").tobytes()
        self.tails = {"": b""}
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.words: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        found = PLAIN.findall("\n".join(chunks))
        if found:
            words, tails = zip(*found, strict=True)
            lower = "\n".join(words).lower().split("\n")
            new = set(lower).difference(self.words)
            if len(self.words) + len(new) > REMEMBERED:
                self.words, new = {}, set(lower)
            listed = list(new)
            self.words.update(zip(listed, self._words(listed), strict=True))
            marks = list(set(tails).difference(self.tails))
            self.tails.update(zip(marks, self._each(marks), strict=True))
            ids = map(add, map(self.words.__getitem__, lower), map(self.tails.__getitem__, tails))
            self.known.update(zip(map(add, words, tails), ids, strict=True))
            chunks = chunks.difference(map(add, words, tails))
        odd = list(chunks)
        self.known.update(zip(odd, self._each(odd), strict=True))

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str], together: int = 50) -> list[bytes]:
        lots = [" ".join(words[i : i + together]) for i in range(0, len(words), together)]
        ids = np.array([i for e in self.encoder.encode_batch_fast(lots, add_special_tokens=False) for i in e.ids], "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self._each(words)
        raw, at = ids.tobytes(), [0, *(stops * 4).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, closed by the closing id.

        Arrow splits the texts and numbers their distinct chunks; only those are looked up one by one.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:  # what came more than once stays
                again = self.again if 2 * len(self.again) < REMEMBERED else set()
                self.known, self.again = {c: self.known[c] for c in again}, set()
            elif 2 * len(self.known) > REMEMBERED:
                self.again.update(c for c, ids in zip(chunks, found, strict=True) if ids is not None)
            self.learn({chunks[i] for i in missing})
            for i in missing:
                found[i] = self.known[chunks[i]]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        ends = np.cumsum(sizes[code])
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[code] - ends + sizes[code], sizes[code]) + np.arange(total)]
        stops = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[i:j].tobytes() + self.closing for i, j in zip(stops, stops[1:])]


@lru_cache(2)
def tokenizer(path: str, closing_id: int) -> ChunkTokenizer:
    """One for each Python worker, kept from task to task."""
    return ChunkTokenizer(path, closing_id)


def slices(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts that hold about size bytes together, or one longer text."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lot = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = 0, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, lot_key, and with ids=True the ids themselves."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("lot_key", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if ids else []
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, row = tokenizer(tokenizer_path, closing_id), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, stop in slices(batch.column("text")):
                part = batch.slice(at, stop - at)
                which, rows, raws = [], [], []
                for i, raw in enumerate(encode(part.column("text"))):
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        cut_out = raw[start : start + 4 * capacity]
                        row += 1
                        which.append(i)
                        rows.append((piece, start // 4, len(cut_out) // 4, zlib.crc32(cut_out), row))
                        if ids:
                            raws.append(np.frombuffer(cut_out, "<u4").astype(np.int32))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=False)]
                columns += [pa.array(raws, pa.list_(pa.int32()))] if ids else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(which)), *columns], names=["doc_id", *(n for n, _ in fields)])

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, lot_key long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


#: Exchanges that the search tries in a lot, at most, and pieces of one bin of which pairs are tried.
STEPS, PAIRED = 3000, 12


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing. Bins by free room in lists, and one bit a room that some bin has, so a fit is one shift."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def swap_search(lengths: np.ndarray, bins: list[list[int]], capacity: int, steps: int = STEPS, paired: int = PAIRED) -> list[list[int]]:
    """Raise the sum of squared fills by moves and swaps out of the emptiest bins until some are empty.

    A step takes one or two pieces out of the emptiest bin that still has a useful step, puts them into a fuller
    underfull bin, and takes nothing (a move) or one smaller piece back. Every step makes the fuller bin fuller by as
    much as the emptier one gets emptier, so the sum of squares rises and the search ends. steps bounds the exchanges
    tried, and paired the pieces of a bin of which pairs are tried; the packing is valid after each step, and a bound
    can only cost bins, never pieces.
    """
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    need = -(-int(fill.sum()) // capacity)
    holder = np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        holder[b] = k
    closed = np.zeros(len(bins), bool)
    live = len(bins)
    while steps > 0 and live > need:
        underfull = (fill > 0) & (fill < capacity)
        sources = np.flatnonzero(underfull & ~closed)
        if not len(sources):
            break
        source = int(sources[np.argmin(fill[sources])])
        fuller = underfull & (fill >= fill[source])
        fuller[source] = False
        other, items = np.flatnonzero(fuller), np.flatnonzero(fuller[holder])
        sizes, room = lengths[items], (capacity - fill)[holder[items]]
        best: tuple[int, tuple[int, ...], int, int] | None = None
        own = bins[source]
        for out in [*((i,) for i in own), *combinations(own[:paired], 2)]:
            steps -= 1
            total = int(lengths[list(out)].sum())
            fits = np.flatnonzero(capacity - fill[other] >= total)
            if len(fits):
                best = (total, out, -1, int(other[fits[np.argmax(fill[other][fits])]]))
                break
            gain = np.where((sizes < total) & (total - sizes <= room), total - sizes, 0)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > (best[0] if best else 0):
                best = (int(gain[k]), out, int(items[k]), int(holder[items[k]]))
        if best is None:
            closed[source] = True
            continue
        gained, out, back, target = best
        for i in out:
            own.remove(i)
            bins[target].append(i)
            holder[i] = target
        if back >= 0:
            bins[target].remove(back)
            own.append(back)
            holder[back] = source
        fill[target] += gained
        fill[source] -= gained
        live -= not own
    return [b for b in bins if b]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, lot: int = LOT, steps: int = STEPS, paired: int = PAIRED) -> DataFrame:
    """Add sequence_id and offset to pieces that have been kept (written and reread).

    lot: pieces packed together. steps, paired: bounds of the search in a lot, as swap_search has them.
    """
    if "ids" in pieces.columns:  # token ids go round the search, which needs lengths only
        places = pack_pieces(pieces.select("length", F.col("lot_key").alias("_piece"), "lot_key"), capacity, lot, steps, paired)
        return pieces.join(places.drop("length"), F.col("lot_key") == F.col("_piece")).drop("lot_key", "_piece")
    lots = max(1, -(-pieces.count() // lot))
    columns = [c for c in pieces.columns if c != "lot_key"]

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lot_key", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for k, members in enumerate(swap_search(lengths, best_fit(lengths, capacity), capacity, steps, paired)):
            sequence[members] = (int(key[0]) << 32) + k
            offset[members] = np.concatenate(([0], np.cumsum(lengths[members])[:-1]))
        return frame[columns].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "lot_key") + ", sequence_id long, offset long"
    return pieces.groupBy(F.pmod(F.xxhash64("lot_key"), F.lit(lots)).alias("lot")).applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = 0, ids: bool = False, lot: int = LOT) -> DataFrame:
    """Tokenize whole documents and pack them; one row a piece with its place. With ids=True each row has its ids."""
    return pack_pieces(keep(token_pieces(docs, tokenizer_path, capacity, closing_id, ids), "pieces"), capacity, lot)
