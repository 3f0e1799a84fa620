"""Operator 11 against whole-text tokenizers and plain loops over bytes."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarryflow.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {v: k for k, v in a.get_vocab().items()}, alignment.byte_alphabet()


def plain(tools, text):
    """Groups of (A ids, B ids), or none."""
    a, b, names, alphabet = tools
    if not text:
        return []
    one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in names[i]) for i in one]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    ends = []
    for parts in (bytes_a, bytes_b):
        at = 0
        ends.append([at := at + len(p) for p in parts])
    shared, groups, i, j = set(ends[0]) & set(ends[1]), [], 0, 0
    for end in sorted(shared):
        x, y = [], []
        while i < len(one) and ends[0][i] <= end:
            x.append(one[i])
            i += 1
        while j < len(two) and ends[1][j] <= end:
            y.append(two[j])
            j += 1
        groups.append((x, y))
    return groups


def brute(tools, docs):
    found = [(d, plain(tools, t)) for d, t in docs]
    linked = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for _, groups in found]
    counts, most = Counter(p for one in linked for p in one), defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (d, groups), links in zip(found, linked, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        out.append((d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), best, sum(counts[p] * n for p, n in links.items()), sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (1, "plain words and more words"), (2, None), (3, ""), (4, " "), (5, "  two  spaces   three\n\n  lines\n \nend  "), (6, "\n\nstarts with lines\r\n\ttabs \t mixed blank　wide"),
    (7, "日本語のテキスト 한국어 текст ünïcödé 😀😀 👩‍👩‍👧 é"), (8, "a▁b holds the mark"), (9, "<|endoftext|> <s> </s> <0x41> [UNK]"), (10, "x" * 3000), (11, "don't we'll 12345 3.14 !!!??? ---- ====" * 20),
    (12, "\x1c\x1d file \x1c\n group\x85next line"), (None, "plain words and more words"), (1, "plain words and more words"), (13, "\x00 zero \x7f"), (14, "tail blank \n "), (15, "\t"), (16, "é" * 400 + "😀" * 50),
]


def test_odd_texts_equal_brute_force(spark, tools):
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in ODD], "doc_id long, text string, row int, links string")
    got = sorted([tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(docs, A, B).collect()], key=str)
    assert got == brute(tools, ODD)
    assert alignment.align_tokenizers(docs.limit(0), A, B).count() == 0


@pytest.mark.parametrize("hot", [alignment.HOT, 100, 0])
def test_query_equals_brute_force(spark, tools, folder, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT", hot)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r[c] for c in COLUMNS) for r in queries.op11_cross_tokenizer_alignment(spark, folder).collect()], key=str)
    assert got == brute(tools, docs)


def test_chunks_meet_whole_texts(tools, monkeypatch):
    """Random strings of blanks, letters and marks; the worker forgets in between and expands groups in small lots."""
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "EXPANDED", 3)
    draw, aligner = random.Random(11), alignment.Aligner(A, B)
    assert not aligner.whole
    alphabet = ["a", "B", "th", "ing", " ", " ", "  ", "\n", "\t", "\r", " ", "　", "\x1c", "\x85", "'s", "1", "23", ".", ",", "é", "日", "😀", "▁", "<s>", "ﬁ"]
    for _ in range(40):
        texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(20)]
        figures, digests, of, pair, times = aligner.read(texts)
        for k, text in enumerate(texts):
            groups = plain(tools, text)
            links = Counter(x * aligner.span + y for xs, ys in groups for x in xs for y in ys)
            assert figures[k].tolist() == [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), links.total()], repr(text)
            assert dict(zip(pair[of == k].tolist(), times[of == k].tolist(), strict=True)) == links
            want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert digests[k] == (sha256(want.encode()).hexdigest() if groups else "")
