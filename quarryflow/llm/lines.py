"""Fuzzy line dedup (operator 6).

Lines are normalised to their lower-case words. Lines with equal words are one class. Each pair of neighbouring words
votes on the 64 bits of the line's SimHash: long lines of one language have most of their words in common, but few pairs.
Two lines are candidates if they agree in a block, if neither is too short for the other and if, where both have VOTERS
pairs to vote, at most FAR bits of their SimHashes differ. Candidates are linked if the edit similarity of their
normalised texts, 1 - distance / longer length, is at least the threshold, whatever their length. Of each connected group the occurrence with the smallest (doc_id, row, line number) stays.

A block is not cut from the line's 64 bits: one changed word of eight already flips some ten of them, so blocks wide
enough to keep chance pairs few would miss most links. Instead a block is made of few of the line's words, drawn by least
hashes, so lines that share a part s of their words agree in it with the chance s ** WORD_ROWS. Shorter words, which
many lines have, are drawn a quarter as often. Lines of FEW words or fewer have blocks of three-character pieces as well.

Defined cases: null and empty texts have no lines; lines without a letter or digit always stay and are never linked;
a null doc_id orders before all others; repeated rows are documents of their own, so the first keeps its lines; an
empty table gives no rows; other columns are untouched and may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quarryflow.llm.common import discard, keep, numbered, tidy
from quarryflow.llm.components import Dense, crowds, linked_within_buckets, with_contents
from quarryflow.llm.minhash import mixed

#: Blocks and the words or pieces that each is made of.
WORD_KEYS, WORD_ROWS = 12, 4
PIECE_KEYS, PIECE_ROWS = 16, 3
BLOCKS, BLOCK_BITS = WORD_KEYS + PIECE_KEYS, 62
#: Shorter words are drawn less often. Pairs of words that must vote for SimHashes to be compared.
LETTERS, VOTERS = 4, 8
FEW = 5
#: Gaps between common words of more characters are taken as replaced in an upper bound.
LONG = 512
#: Pairs are compared at once in classes of so many words of 64 letters; pairs, and cells of the table of letters, at once.
WORDS, AT_ONCE, CELLS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32]), 4096, 1 << 22
#: Fewer pairs than so many a word are compared one by one.
FEW_PAIRS = 20
#: Buckets of more lines that stay apart are compared by blocks.
LARGE = 64
#: Bits of 64 in which two SimHashes may differ: of lines with one word in five replaced, 18 on average.
FAR = 26
_SEEDS = np.random.default_rng(6).integers(1, 2**63, WORD_KEYS * WORD_ROWS + PIECE_KEYS * PIECE_ROWS, dtype=np.uint64) | np.uint64(1)
#: Characters that are hashed at once, and the powers of a base and of its inverse modulo 2 ** 64.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSE = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(SLICE, x, np.uint64))), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
#: Which of the first 65,536 characters belong to words.
_IN_WORDS = np.array([c.isalnum() or c == "_" for c in map(chr, range(1 << 16))])
#: The lower-case letters of the first 256 characters, blanks for those outside words; each stays one of the 256.
_PLAIN = "".join(c.lower() if _IN_WORDS[ord(c.lower())] or c == "\n" else " " for c in map(chr, range(256))).encode("latin-1")


def plain_lines(text: str) -> list[str]:
    """The normalised lines of a text: lower-case words joined by one space; empty where a line has none."""
    try:  # most texts have no other characters
        return [" ".join(line.split()) for line in text.encode("latin-1").translate(_PLAIN).decode("latin-1").split("\n")]
    except UnicodeEncodeError:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").copy()
    wide = codes >= 1 << 16
    held = _IN_WORDS[np.where(wide, 0, codes)]
    if wide.any():
        kinds, which = np.unique(codes[wide], return_inverse=True)
        held[wide] = np.array([chr(c).isalnum() for c in kinds.tolist()])[which]
    codes[~held & (codes != 10)] = 32
    gaps = codes == 32
    return [line.strip(" ") for line in codes[~(gaps & np.concatenate(([False], gaps[:-1])))].tobytes().decode("utf-32-le").split("\n")] if len(codes) else [""]


def normalised(line: str) -> list[str]:
    return [word for part in plain_lines(line) for word in part.split()]


def word_hashes(plain: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length and line number of each word of normalised, non-empty lines, in order.

    The polynomial of a word's characters is the difference of two running sums over all characters. So many characters
    are read at a time, cut between words; a longer word is hashed by itself.
    """
    whole = "\n".join(plain)
    try:
        codes = np.frombuffer(whole.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(whole.encode("utf-32-le", "replace"), "<u4")
    hashes, sizes, lines, at, line = [], [], [], 0, 0
    while at < len(codes):
        part = codes[at : at + SLICE]
        gaps = np.flatnonzero((part == 32) | (part == 10))
        if at + len(part) < len(codes):
            if not len(gaps):
                whole = codes[at:]
                later = np.flatnonzero((whole == 32) | (whole == 10))
                size = int(later[0]) if len(later) else len(whole)
                hashes.append(np.array([xxh3_64_intdigest(whole[:size].astype("<u4").tobytes())], np.uint64))
                sizes.append(np.array([size]))
                lines.append(np.array([line]))
                if size < len(whole):
                    line += int(whole[size] == 10)
                at += size + 1
                continue
            part, gaps = part[: gaps[-1]], gaps[:-1]
        starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(part))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * _POWERS[: len(part)], dtype=np.uint64)))
        hashes.append(mixed((total[ends] - total[starts]) * _INVERSE[starts]))
        sizes.append(ends - starts)
        breaks = (part[gaps] == 10).cumsum()
        lines.append(line + np.concatenate(([0], breaks)))
        line = int(lines[-1][-1])
        at += len(part) + 1
        if at <= len(codes):
            line += int(codes[at - 1] == 10)
    return np.concatenate(hashes), np.concatenate(sizes), np.concatenate(lines)


def draws(hashes: np.ndarray, light: np.ndarray | None, starts: np.ndarray, seeds: np.ndarray, rows: int, first: int) -> np.ndarray:
    """(sets, keys): blocks of so many least-hash draws each of sets of hashes that begin at starts.

    light marks elements that are drawn a quarter as often. first: the number of the first block, so that blocks of
    different numbers never agree.
    """
    keys, bounds = len(seeds) // rows, np.append(starts, len(hashes))
    least, at = np.zeros((len(starts), len(seeds)), np.uint64), 0
    if light is not None:  # there are few short words, so each is drawn once
        kinds, kind = np.unique(hashes[light], return_inverse=True)
        rare, place = np.zeros((len(kinds), len(seeds)), np.uint64), np.cumsum(light) - 1
        for more in (1, 3, 5, 7):  # the largest of four hashes is a quarter as often the least
            np.maximum(rare, kinds[:, None] * (seeds * np.uint64(more))[None, :], out=rare)
    while at < len(starts):  # so many elements at once
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 1024, side="right")) - 1)
        low, high = bounds[at], bounds[stop]
        values = hashes[low:high, None] * seeds[None, :]
        if light is not None and len(some := np.flatnonzero(light[low:high])):
            values[some] = rare[kind[place[low + some]]]
        np.minimum.reduceat(values, bounds[at:stop] - low, axis=0, out=least[at:stop])
        at = stop
    least >>= np.uint64(32)
    total = np.arange(first + 1, first + keys + 1, dtype=np.uint64)[None, :]
    for row in range(rows):
        total = mixed(total * np.uint64(_BASE) + least[:, row::rows])
    return (total >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)


def ayes(ballots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, 64): how many of the 64-bit ballots of each set have each bit, in the order of np.unpackbits of their bytes.

    Eight counters of a byte lie in one long, so at most 255 ballots are added up at once.
    """
    parts = -(-np.diff(np.append(starts, len(ballots))) // 255)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts - 255 * first, parts) + 255 * np.arange(parts.sum())
    ones = np.uint64(0x0101010101010101)
    counts = [np.add.reduceat(ballots >> np.uint64(7 - k) & ones, cuts).view(np.uint8).reshape(-1, 8) for k in range(8)]
    return np.add.reduceat(np.stack(counts, axis=2).reshape(-1, 64), first, axis=0, dtype=np.int32)


def simhashes(plain: list[str]) -> tuple[np.ndarray, list[int | None]]:
    """(lines, BLOCKS) blocks and the SimHash of each normalised line, null with few voters.

    Negative blocks are none and differ from line to line.
    """
    hashes, sizes, of = word_hashes(plain)
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])
    within = of[1:] == of[:-1]
    pairs, pairs_of = pairs[within], of[1:][within]
    order = np.argsort(of.astype(np.uint64) << np.uint64(43) | hashes >> np.uint64(21)) if len(plain) < 1 << 21 else np.lexsort((hashes, of))
    hashes, sizes, of = hashes[order], sizes[order], of[order]
    once = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])))  # each distinct word counts once
    hashes, sizes, of = hashes[once], sizes[once], of[once]
    starts = np.searchsorted(of, np.arange(len(plain)))

    out = np.repeat(-1 - np.arange(len(plain))[:, None], BLOCKS, axis=1)
    out[:, :WORD_KEYS] = draws(hashes, sizes < LETTERS, starts, _SEEDS[: WORD_KEYS * WORD_ROWS], WORD_ROWS, 0)
    voters = np.bincount(pairs_of, minlength=len(plain))
    votes: list[int | None] = [None] * len(plain)
    many = voters >= VOTERS
    if many.any():
        own = np.concatenate(([0], np.cumsum(voters[many])[:-1]))
        bits = np.packbits(2 * ayes(pairs[many[pairs_of]], own) > voters[many][:, None], axis=1).view(np.int64).ravel()
        for i, b in zip(np.flatnonzero(many).tolist(), bits.tolist(), strict=True):
            votes[i] = b
    few = np.flatnonzero(np.diff(np.append(starts, len(of))) <= FEW)
    if len(few):
        pieces = [list({f"^{w}$"[k : k + 3]: None for w in dict.fromkeys(plain[i].split(" ")) for k in range(len(w))}) for i in few]
        found = np.fromiter((xxh3_64_intdigest(x.encode("utf-8", "replace")) for one in pieces for x in one), np.uint64)
        out[few, WORD_KEYS:] = draws(found, None, np.cumsum([0, *map(len, pieces)])[:-1], _SEEDS[WORD_KEYS * WORD_ROWS :], PIECE_ROWS, WORD_KEYS)
    return out, votes


def simhash_blocks(lines: list[list[str]]) -> np.ndarray:
    return simhashes([" ".join(line) for line in lines])[0]


def read_lines(rows: DataFrame) -> DataFrame:
    """One row a line with words: row, line, key (digest of its words), size (of its normalised text), votes, blocks."""

    def lines_of(row: list, texts: list) -> pa.RecordBatch:
        which, line, plain = [], [], []
        for r, text in zip(row, texts, strict=True):
            for i, p in enumerate(plain_lines(text or "")):
                if p:
                    which.append(r)
                    line.append(i)
                    plain.append(p)
        keys = [blake2b(p.encode("utf-8", "replace"), digest_size=16).digest() for p in plain]
        blocks, votes = simhashes(plain) if plain else (np.zeros((0, BLOCKS), np.int64), [])
        real = blocks >= 0
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *real.sum(1)]), pa.int32()), pa.array(blocks[real]))
        columns = [pa.array(which, pa.int64()), pa.array(line, pa.int32()), pa.array(keys, pa.binary()), pa.array(list(map(len, plain)), pa.int32()), pa.array(votes, pa.int64()), lists]
        return pa.RecordBatch.from_arrays(columns, names=["row", "line", "key", "size", "votes", "blocks"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts, held = [], [], 0
            for r, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                row.append(r)
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held > 250_000:
                    yield lines_of(row, texts)
                    row, texts, held = [], [], 0
            yield lines_of(row, texts)

    return rows.select("row", "text").mapInArrow(read, "row long, line int, key binary, size int, votes long, blocks array<long>")


def line_texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(node, content, votes): the normalised texts of chosen lines. places: (node, row, line, votes).

    Whole texts are dealt by row; what is wanted of them is small and hashed, so that texts need no sorting. Only the
    chosen lines are normalised, those of several texts at once.
    """
    wanted = places.groupBy("row").agg(F.collect_list(F.struct("line", "node", "votes")).alias("wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node, found, votes = [], [], []
                for text, asked in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    held = text.split("\n")
                    node += [x["node"] for x in asked]
                    found += [held[x["line"]] for x in asked]
                    votes += [x["votes"] for x in asked]
                plain = plain_lines("\n".join(found))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(plain, pa.string()), pa.array(votes, pa.int64())], names=["node", "content", "votes"])

    return rows.join(wanted.hint("shuffle_hash"), "row").select("text", "wanted").mapInArrow(read, "node long, content string, votes long")


def similar_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines with edit similarity of at least percent. The SimHashes are compared first."""
    of = lambda c: texts.select(F.col("node").alias(c), F.col("votes").alias(f"votes_{c}"))
    near = F.coalesce(F.bit_count(F.col("votes_a").bitwiseXOR(F.col("votes_b"))) <= FAR, F.lit(True))
    near = keep(pairs.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b"), "near")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("content_a", "content_b"))
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y, percent) for x, y in zip(one, two, strict=True)], pa.bool_()))

    return with_contents(near, texts.select("node", "content"), spread=True).mapInArrow(confirm, "a long, b long")


def similar(one: str, two: str, percent: int) -> bool:
    """Whether the edit similarity is at least percent; bounds of the distance that are cheap decide first."""
    most = max(len(one), len(two)) * (100 - percent) // 100
    if abs(len(one) - len(two)) > most:
        return False
    start = common_start(one, two)
    one, two = one[start:], two[start:]
    if end := common_start(one[::-1], two[::-1]):  # what lies between is as far apart as the whole
        one, two = one[:-end], two[:-end]
    if max(len(one), len(two)) <= most:
        return True
    some, others = one.split(" "), two.split(" ")
    cost = aligned_cost(some, others)
    if cost <= most:
        return True
    if letters_apart(one, two) > most:
        return False
    tried = min(len(one), len(two)) > LONG and cost <= 2 * most  # else edits between common words seldom are few enough
    return tried and aligned_cost(some, others, True, most) <= most or edit_distance_within(one, two, most)


def common_start(one: str, two: str) -> int:
    """How many characters two texts have in common from the start, by halving."""
    low, high = 0, min(len(one), len(two))
    while low < high:
        middle = (low + high + 1) // 2
        if one[low:middle] == two[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def letters_apart(one: str, two: str) -> int:
    """A lower bound of the edit distance: letters that either line has more of."""
    kinds = set(one) | set(two)
    more = [one.count(c) - two.count(c) for c in kinds]
    return max(sum(x for x in more if x > 0), -sum(x for x in more if x < 0))


def aligned_cost(one: list[str], two: list[str], exact: bool = False, most: int | None = None) -> int:
    """An upper bound of the edit distance of two lines of words: the cost of changing what lies between common words.

    Words that either line has once are matched, as many as keep their order; between them, and at both ends, equal
    words are matched from either side, and the rest is replaced, or, with exact, edited where it is short. With most,
    any larger number may stand for a cost beyond it.
    """
    once, again = Counter(one), Counter(two)
    at = {w: j for j, w in enumerate(two) if again[w] == 1}
    pairs = [(i, at[w]) for i, w in enumerate(one) if once[w] == 1 and w in at]
    if any(y < x for (_, x), (_, y) in pairwise(pairs)):
        tails, ends, before = [], [], []  # longest rising run
        for k, (_, j) in enumerate(pairs):
            slot = bisect_left(tails, j)
            tails[slot:slot + 1], ends[slot:slot + 1] = [j], [k]
            before.append(ends[slot - 1] if slot else -1)
        k, chain = ends[-1], []
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        pairs = chain[::-1]
    cost, i, j = 0, 0, 0
    for x, y in [*pairs, (len(one), len(two))]:
        if x > i or y > j:
            a, b = x, y
            while i < a and j < b and one[i] == two[j]:
                i, j = i + 1, j + 1
            while i < a and j < b and one[a - 1] == two[b - 1]:
                a, b = a - 1, b - 1
            if i < a or j < b:
                x_size, y_size = sum(map(len, one[i:a])) + a - i, sum(map(len, two[j:b])) + b - j
                cost += edit_distance(" ".join(one[i:a]) + " ", " ".join(two[j:b]) + " ") if exact and i < a and j < b and max(x_size, y_size) <= LONG else max(x_size, y_size)
        if most is not None and cost > most:
            break
        i, j = x + 1, y + 1
    return cost


def edit_distance_within(one: str, two: str, most: int) -> bool:
    return abs(len(one) - len(two)) <= most and edit_distance(one, two, most) <= most


def edit_distance(one: str, two: str, most: int | None = None) -> int:
    """Levenshtein's distance by columns of bits (Myers 1999), one whole column a step in a long integer.

    With most, any larger number may stand for a distance beyond it. On the diagonal that ends in the last cell the
    numbers never fall, and the last row falls by one a column at most, so unlike lines are left where either shows it;
    both are looked at every few columns.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << i
    full, up, down = (1 << len(one)) - 1, (1 << len(one)) - 1, 0
    step = len(two) if most is None else 16
    for start in range(0, len(two), step or 1):
        for c in two[start : start + step]:
            equal = places.get(c, 0)
            diagonal = (((equal & up) + up ^ up) | equal | down) & full
            rise = (down | full ^ (diagonal | up)) << 1 | 1
            up, down = ((up & diagonal) << 1 | full ^ (diagonal | rise & full)) & full, rise & diagonal
        if most is not None:
            at = min(start + step, len(two))
            if at + up.bit_count() - down.bit_count() - (len(two) - at) > most:
                return most + 1
            if (row := len(one) - len(two) + at) > 0:
                above = (1 << row) - 1
                if at + (up & above).bit_count() - (down & above).bit_count() > most:
                    return most + 1
    return len(two) + up.bit_count() - down.bit_count()


def similar_many(texts: list[str], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """similar() of the pairs (texts[a[k]], texts[b[k]]): pairs of like length are worked on at once, few by themselves.

    For pairs most of which are unlike; of others the cheap bounds of similar() decide sooner.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    a, b = np.where(sizes[a] < sizes[b], b, a), np.where(sizes[a] < sizes[b], a, b)  # the longer one first
    most = sizes[a] * (100 - percent) // 100
    out = most >= sizes[a]
    open_ones = np.flatnonzero(~out & (sizes[a] - sizes[b] <= most))
    if not len(open_ones):
        return out
    whole = "".join(texts)
    try:
        codes = np.frombuffer(whole.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
    letters[codes] = 1
    kinds = int(letters.sum()) + 1  # 0: no letter
    codes, starts = np.cumsum(letters, dtype=np.int32)[codes], np.cumsum(sizes) - sizes
    bags = np.bincount(np.repeat(np.arange(len(texts)) * 64, sizes) + codes % 64, minlength=64 * len(texts)).astype(np.int32).reshape(-1, 64)
    near = []
    for at in range(0, len(open_ones), AT_ONCE):  # letters that either line has more of
        part = open_ones[at : at + AT_ONCE]
        more = bags[a[part]] - bags[b[part]]
        near.append(part[np.maximum(more, 0).sum(axis=1) <= most[part]])  # the longer one has more letters in all
    open_ones = np.concatenate(near)
    words = -(-sizes[a[open_ones]] // 64)
    classes, alone = np.searchsorted(WORDS, words), []  # at WORDS or fewer; beyond, one by one
    for k in np.unique(classes).tolist():
        some = open_ones[classes == k]
        if k == len(WORDS) or len(some) < FEW_PAIRS * WORDS[k]:
            alone.append(some)
            continue
        some = some[np.argsort(a[some], kind="stable")]
        step = max(FEW_PAIRS, min(AT_ONCE, CELLS // (kinds * WORDS[k])))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            found = _within(codes, starts, sizes, a[part], b[part], most[part], kinds, WORDS[k])
            out[part] = found == 1
            alone.append(part[found < 0])
    for k in np.concatenate(alone).tolist() if alone else []:
        out[k] = similar(texts[a[k]], texts[b[k]], percent)
    return out


def _within(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, kinds: int, words: int) -> np.ndarray:
    """1 where the edit distance of a pair (a, b) is at most most, 0 where not, -1 where too few pairs were left to go on.

    a is not the shorter one, and has up to so many words of 64 letters.

    The columns of bits of edit_distance() for many pairs, in words that pass their carry on (Hyyro 2003). A word is
    begun when the first column comes near it; the cells that it had before are beyond most for certain. The pairs lie in
    falling order of columns, so those that end are the last; pairs whose diagonal shows too much are left.
    """
    one = np.uint64(1)
    held, which = np.unique(a, return_inverse=True)
    table = np.zeros((words, len(held) * kinds), np.uint64)  # by word, text and letter: the places of the letter
    total = sizes[held]
    place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    cells = np.repeat(np.arange(len(held)) * kinds, total) + codes[np.repeat(starts[held], total) + place]
    np.add.at(table.reshape(-1), place // 64 * table.shape[1] + cells, one << (place % 64).astype(np.uint64))

    order = np.argsort(-sizes[b], kind="stable")
    rows, columns, limit, base = sizes[a][order], sizes[b][order], most[order], which[order] * kinds
    longest, out = int(columns[0]), np.zeros(len(a), np.int8)
    at = np.arange(longest)[:, None]
    letter = np.where(at < columns[None, :], codes[np.minimum(starts[b][order][None, :] + at, len(codes) - 1)], 0)
    up, down = np.full((words, len(a)), ~np.uint64(0)), np.zeros((words, len(a)), np.uint64)
    reach = int(limit.max())

    def cell(row: np.ndarray, column: int, first: int, used: int) -> np.ndarray:
        """The numbers in these rows of a column, of the pairs from first on."""
        number = np.full(len(row), column)
        for w in range(used):
            bits = np.clip(row - 64 * w, 0, 64)
            mask = np.where(bits == 64, ~np.uint64(0), (one << np.minimum(bits, 63).astype(np.uint64)) - one)
            number += np.bitwise_count(up[w, first:] & mask).astype(np.int64) - np.bitwise_count(down[w, first:] & mask)
        return number

    for j in range(1, longest + 1):
        used = min(words, (j + reach) // 64 + 1)
        equal, plus, minus = base + letter[j - 1], one, np.uint64(0)
        for w in range(used):
            same, rises, falls = table[w].take(equal), up[w], down[w]
            upright = same | falls
            same |= minus
            level = (((same & rises) + rises) ^ rises) | same
            more, less = falls | ~(level | rises), rises & level
            out_plus, out_minus = more >> np.uint64(63), less >> np.uint64(63)
            more, less = more << one | plus, less << one | minus
            up[w], down[w] = less | ~(upright | more), more & upright
            plus, minus = out_plus, out_minus
        left = int(np.searchsorted(-columns, -j))  # pairs with further columns
        if left < len(columns):
            out[order[left:]] = cell(rows[left:], j, left, used) <= limit[left:]
            kept, n = slice(left), left  # no copy
        elif j % 16 == 0:
            kept = np.flatnonzero(cell(rows - columns + j, j, 0, used) <= limit)
            n = len(kept)
        else:
            continue
        if n < FEW_PAIRS // 2 * used and 2 * j < longest:
            out[order[kept]] = -1
            break
        if not n:
            break
        if n < len(columns):
            order, rows, columns, limit, base, letter, up, down = order[kept], rows[kept], columns[kept], limit[kept], base[kept], letter[:, kept], up[:, kept], down[:, kept]
    return out


def prepared(content: dict) -> tuple[str, int | None]:
    """Text and SimHash; the SimHash travels as text, since whole numbers beside nulls would become floats."""
    return content["plain"], None if content["votes"] is None else int(content["votes"])


@tidy
def repeated_lines(rows: DataFrame, percent: int) -> DataFrame:
    """(row, gone), kept: the line numbers that go, by document. rows: (row, doc_id, text), the same at each reading."""
    read = keep(read_lines(rows), "read")
    classes = read.groupBy("key").agg(F.min(F.struct("row", "line")).alias("place"), F.first("size").alias("size"), F.first("votes").alias("votes"), F.first("blocks").alias("blocks"), F.count("*").alias("n"))
    blocked = keep(classes.withColumn("node", F.monotonically_increasing_id()), "blocked")
    lines = keep(read.select("row", "line", "key"), "lines")
    discard(read)
    shared = crowds(blocked.select(F.explode("blocks").alias("bucket"), "node", "size"))
    classes = keep(blocked.drop("blocks"), "classes")
    discard(blocked)

    wanted = classes.select("node", "place.row", "place.line", "votes").join(shared.select("node").distinct(), "node", "left_semi")
    texts = keep(line_texts(rows.select("row", "text"), wanted), "texts")

    content = texts.select("node", F.struct(F.col("content").alias("plain"), F.col("votes").cast("string").alias("votes")).alias("content"))

    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    def sieve(some: list[tuple], others: list[tuple]) -> np.ndarray:
        """Which pairs have lengths and SimHashes near enough, a whole block at once."""
        (x, v, h), (y, w, g) = ((np.array([len(c[0]) for c in held]), np.array([(c[1] or 0) & (2**64 - 1) for c in held], np.uint64), np.array([c[1] is not None for c in held])) for held in (some, others))
        near = np.bitwise_count(v[:, None] ^ w[None, :]) <= FAR
        return (near | ~h[:, None] | ~g[None, :]) & (100 * np.minimum(x[:, None], y[None, :]) >= percent * np.maximum(x[:, None], y[None, :]))

    def linked_many(some: list[tuple], others: list[tuple], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return similar_many([c[0] for c in (*some, *others)], a, len(some) + b, percent)

    dense = Dense(content, prepared, lambda a, b: similar(a[0], b[0], percent), LARGE, 256, 1024, merge=False, sieve=sieve, linked_many=linked_many)
    roots = linked_within_buckets(shared, lambda pairs: similar_pairs(pairs, texts, percent), fits, dense)

    groups = classes.select("key", "node", "n").join(roots, "node", "left").where("root IS NOT NULL OR n > 1")
    groups = keep(groups.select("key", F.coalesce("root", "node").alias("root")), "groups")
    found = lines.select("row", "line", "key").join(groups, "key").join(rows.select("row", "doc_id"), "row")
    found = keep(found.select("root", F.struct("doc_id", "row", "line").alias("place")), "repeated")
    first = keep(found.groupBy("root").agg(F.min("place").alias("first")), "first")
    gone = found.join(first, "root").where("place <> first")
    return keep(gone.groupBy(F.col("place.row").alias("row")).agg(F.collect_list("place.line").alias("gone")), "gone")


def dedup_lines(docs: DataFrame, percent: int = 80, stored: bool = False) -> DataFrame:
    """One row a document: doc (struct of all columns of docs, as they came), kept_text, n_lines and n_removed.

    stored: docs are files read as they are, so no copy is needed (common.numbered).
    """
    rows = numbered(docs, stored)
    gone = repeated_lines(rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")), percent)

    @F.pandas_udf("string")
    def without(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, lines in zip(texts, lists, strict=True):
            drop = set(() if lines is None else lines.tolist())
            out.append(None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
        return pd.Series(out, dtype=object)

    df = rows.join(gone.hint("shuffle_hash"), "row", "left").withColumn("_n", F.coalesce(F.size("gone"), F.lit(0)))
    text = F.col("doc.text")
    kept = F.coalesce(without(F.when(F.col("_n") > 0, text), F.col("gone")), text)
    n_lines = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return df.select("doc", kept.alias("kept_text"), n_lines.cast("long").alias("n_lines"), F.greatest("_n", F.lit(0)).cast("long").alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, percent: int = 80, stored: bool = False) -> DataFrame:
    """docs with the kept lines as text, and n_chars, where there is one, counted anew."""
    found = dedup_lines(docs, percent, stored)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*((new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
