"""Each operator against brute force, on the small tables and on odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import same
from quarryflow.llm import components, fingerprints, licenses, lines, minhash, mixing, packing, quality, queries, secrets, substrings
from quarryflow.llm.common import keep, numbered, tidy
from quarryflow.llm.queries import word_bpe_path


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def brute_groups(texts, k, percent):
    """Components of (id, text) by exact Jaccard; ids are not null and unique."""
    sets = {i: minhash.shingles(minhash.shingle_words(t), k) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_equals_exact_groups(spark, folder, k):
    docs = documents(spark, folder)
    groups, sizes = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], k, 80)
    got = minhash.group_documents(docs, k, 80).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (g, sizes[i]) for i, g in groups.items()}
    assert sum(r["first"] for r in got) == len(set(groups.values()))


def test_minhash_refines_crowds(spark):
    """Many texts with a common passage, and a group of near copies larger than a crowd."""
    rng = np.random.default_rng(0)
    word = lambda: "w%d" % rng.integers(10**6)
    common, base = [word() for _ in range(30)], [word() for _ in range(60)]
    texts = [" ".join(common + [word() for _ in range(25)]) for _ in range(40)]
    for i in range(40):
        copy = list(base)
        copy[int(rng.integers(60))] = word()
        texts.append(" ".join(copy[: 60 - i % 3]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups, _ = brute_groups(enumerate(texts), 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in minhash.group_documents(docs, 2, 80).collect()} == groups


def test_sketch_agreement_is_jaccard():
    rng = np.random.default_rng(1)
    seen = []
    for n in (3, 40, 1000):
        both = rng.integers(0, 2**63, 8 * n, dtype=np.uint64)
        a, b = np.concatenate((both, rng.integers(0, 2**63, n, dtype=np.uint64))), np.concatenate((both, rng.integers(0, 2**63, n, dtype=np.uint64)))
        x, y = minhash.sketch(a), minhash.sketch(b)
        assert x.max() < np.iinfo(np.uint64).max
        seen.append((x == y).mean())
    assert all(abs(s - 0.8) < 0.15 for s in seen)


def test_minhash_odd_rows(spark, odd_docs, no_docs):
    got = [(r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.group_documents(odd_docs, 2, 80).collect()]
    groups = {i: c for i, c, _ in got}
    assert len(got) == 20 and groups[2] == groups[3] == groups[4] == 1 and groups[5] == 5 and groups[6] == 6 and groups[None] is None
    assert {n for i, _, n in got if i in (5, 6, 7)} == {0} and (8, 8, 1) in got
    kept = minhash.drop_near_duplicates(odd_docs, 2, 80)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()).count(16) == 1
    assert minhash.group_documents(no_docs).count() == 0


def test_licenses(spark, folder, odd_docs, no_docs):
    same(queries.op2_license_scan(spark, folder), folder, licenses.oracle_sql())
    got = {r["doc_id"]: r["licenses"] for r in licenses.digest(licenses.scan(odd_docs)).collect()}
    assert got[10] == "Apache-2.0" and got[5] == got[6] == got[None] == ""
    assert licenses.scan(no_docs).count() == 0


def test_license_sequences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND! In no event shall the authors be liable."
    half = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
    docs = spark.createDataFrame([(1, mit), (2, half), (3, mit + "\n" + mit + "\nAll rights reserved.")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_licenses"], r["n_unmatched"]) for r in licenses.digest(licenses.scan(docs)).collect()}
    assert got == {1: ("MIT", 1, 0), 2: ("", 0, 1), 3: ("All-Rights-Reserved,MIT", 3, 0)}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_equal_brute_force(spark, folder, odd_docs, no_docs):
    for docs in (documents(spark, folder), odd_docs):
        got = secrets.digest(secrets.scan(docs)).collect()
        texts = Counter((r["doc_id"], tuple(brute_spans(r["text"] or ""))) for r in docs.collect())
        name = dict(enumerate(secrets.KINDS))
        want = Counter((i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(",".join(f"{name[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()) for (i, spans), n in texts.items() for _ in range(n))
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert secrets.digest(secrets.scan(no_docs)).count() == 0


def test_secret_entropy(spark):
    strings = ["q7Rz0PLm4Xt9Kc2VbN8sWd3F", "abcabcabcabcabcabcabcabc1", "0F3A9C1D7E2B8A465F0C", "thisisaverylongwordwithoutanydigits", "123e4567-e89b-42d3-a456-426614174000", "EXAMPLEq7Rz0PLm4Xt9Kc2Vb", "y" * 19 + "q7Rz0PLm4Xt9Kc2VbN8s"]
    docs = spark.createDataFrame([(i, f"see {s} here") for i, s in enumerate(strings)], "doc_id long, text string")
    got = {r["doc_id"]: [(e["kind"], e["start"], e["end"]) for e in r["entropy"]] for r in secrets.scan(docs).collect()}
    assert got == {0: [("entropy_mixed", 4, 28)], 1: [], 2: [("entropy_hex", 4, 24)], 3: [], 4: [], 5: [], 6: [("entropy_mixed", 4, 43)]}
    bits = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.most_entropy(F.col("s")).alias("b")).collect()
    for s, b in bits:
        windows = [Counter(s[i : i + 20]) for i in range(len(s) - 19)]
        assert abs(b - max(-sum(c / 20 * np.log2(c / 20) for c in w.values()) for w in windows)) < 1e-9


def test_secrets_use_no_python(spark, folder):
    plan = queries.op3_secret_scan(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_on_held_out_rows(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op4_quality_classifier(spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels) >= 0.95 * len(labels)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(odd_docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 1)], "doc_id long, quality int")
    assert quality.keep_good(odd_docs, one).count() == odd_docs.count()
    assert quality.classify(no_docs, one).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_mixing(spark, folder, odd_docs, no_docs):
    for docs in (documents(spark, folder), odd_docs):
        sizes = defaultdict(int)
        for r in docs.collect():
            sizes[r["source"]] += len((r["text"] or "").encode().split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: 1 + i % 3 for i, s in enumerate(order)}
        target, total = {}, sum(sizes.values())
        while True:  # stop sources at three times their size, reshare the rest
            open_ones = [s for s in order if s not in target]
            level = (total - sum(target.values())) / max(1, sum(weight[s] for s in open_ones))
            over = [s for s in open_ones if level * weight[s] > 3 * sizes[s]]
            if not over:
                target |= {s: level * weight[s] for s in open_ones}
                break
            target |= {s: 3.0 * sizes[s] for s in over}
        plan = mixing.mix_plan(docs).select("source", "size", "source_size", "target", mixing.words_taken().alias("taken")).collect()
        taken = Counter()
        for r in plan:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert mixing.mix_plan(no_docs).count() == 0
    again = mixing.mix_plan(documents(spark, folder)).select("doc_id", "draws")
    assert Counter(map(str, again.collect())) == Counter(map(str, mixing.mix_plan(documents(spark, folder)).select("doc_id", "draws").collect()))


def test_mix_documents_have_the_words_drawn(spark, folder):
    for r in mixing.mix_documents(documents(spark, folder), block=8, shard_words=2000).collect():
        assert len(r["text"].encode().split()) == r["mix_words"]


def test_splitting_tree_deals_every_block_once():
    quotas = np.array([5, 0, 17, 100])
    leaves = [mixing.shard_draws(quotas, shard, 8, 1) for shard in range(8)]
    at = np.zeros_like(quotas)
    for start, own in leaves:
        assert (start == at).all()
        at = at + own
    assert (at == quotas).all() and max(o.sum() for _, o in leaves) - min(o.sum() for _, o in leaves) <= 3


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1]


@pytest.mark.parametrize("large", [lines.LARGE, 1])
def test_line_dedup_equals_brute_force(spark, odd_docs, no_docs, large, monkeypatch):
    monkeypatch.setattr(lines, "LARGE", large)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    pool = [" ".join(word() for _ in range(30)) for _ in range(12)]
    texts = []
    for _ in range(40):
        chosen = []
        for line in rng.choice(pool, 4):
            words = line.split()
            if rng.random() < 0.4:
                words[int(rng.integers(30))] = word()
            chosen.append(" ".join(words) + rng.choice(["", ".", " !"]))
        texts.append("\n".join([*chosen, "", "--"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    occurrences = [((i, n), lines.normalised(x)) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if lines.normalised(x)]
    plain = sorted({" ".join(w) for _, w in occurrences})
    blocks = lines.simhash_blocks([p.split() for p in plain])
    group = {p: p for p in plain}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(plain):
        for j in range(i):
            b, longer = plain[j], max(len(a), len(plain[j]))
            if (blocks[i] == blocks[j]).any() and levenshtein(a, b) <= longer * 20 // 100:
                group[find(a)] = find(b)
    first, kept = {}, defaultdict(list)
    for place, words in occurrences:
        first.setdefault(find(" ".join(words)), place)
    for i, t in enumerate(texts):
        for n, x in enumerate(t.split("\n")):
            if not lines.normalised(x) or first[find(" ".join(lines.normalised(x)))] == (i, n):
                kept[i].append(x)
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(docs).select("doc.doc_id", "kept_text").collect()}
    assert got == {i: "\n".join(kept[i]) for i in range(len(texts))}
    assert len(first) < len(plain)
    odd = lines.drop_repeated_lines(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count()
    found = {r["doc_id"]: r for r in odd.collect()}
    assert found[14]["text"] == "same line\nother" and found[14]["n_chars"] == 15 and found[5]["text"] is None and found[7]["text"] == "   \n\n "
    assert lines.dedup_lines(no_docs).count() == 0


def test_large_buckets_of_lines_with_and_without_a_simhash(spark, monkeypatch):
    """Lines of six words, too few to vote, and of more, in one large bucket: every link of the bucket is found."""
    monkeypatch.setattr(lines, "LARGE", 1)
    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(8)]
    texts = [" ".join([*base, *(word() for _ in range(int(rng.integers(0, 5))))]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).select("doc.doc_id", "n_removed").collect()}
    plain = sorted(set(texts))
    blocks, votes = lines.simhashes(plain)
    assert any(v is None for v in votes) and any(v is not None for v in votes)
    group = {t: t for t in plain}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(plain):
        for j in range(i):
            near = votes[i] is None or votes[j] is None or ((votes[i] ^ votes[j]) & (2**64 - 1)).bit_count() <= lines.FAR
            if near and (blocks[i] == blocks[j]).any() and levenshtein(a, plain[j]) <= max(len(a), len(plain[j])) * 20 // 100:
                group[find(a)] = find(plain[j])
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(find(t), i)
    assert got == {i: int(first[find(t)] != i) for i, t in enumerate(texts)}


def test_simhash_is_a_vote():
    blocks = lines.simhash_blocks([["a", "b", "c"], ["c", "b", "a"], ["x"]])
    assert (blocks[0] == blocks[1]).all() and (blocks < 1 << lines.BLOCK_BITS).all()


def test_fingerprints(spark, folder, odd_docs, no_docs):
    rows = sorted(documents(spark, folder).select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in fingerprints.describe(documents(spark, folder)).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = fingerprints.edited(text, following)
        a, b, c = fingerprints.fingerprints([text, new, following])
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.decode(), b.decode())
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    odd = fingerprints.fingerprint_documents(odd_docs).collect()
    assert len(odd) == 20 and len({r["fingerprint"] for r in odd if r["doc_id"] in (1, 2)}) == 1 and {r["class_id"] for r in odd if r["doc_id"] in (1, 2)} == {1}
    assert fingerprints.fingerprint_documents(no_docs).count() == 0
    assert fingerprints.fingerprint_documents(odd_docs.where("doc_id = 8")).head()["near_next"] == 1.0


def test_fingerprints_depend_on_their_text_alone():
    """Each text alone, among short ones and beside a long one; prints of short texts differ; likeness lies in 0 to 1."""
    draw = np.random.default_rng(77)
    texts = ["".join(draw.choice(list("abcdefgh é日"), n)) for n in [*range(1, 12)] * 30] + ["b", "a", "ab", " "]
    alone = [fingerprints.fingerprints([t])[0] for t in texts]
    assert fingerprints.fingerprints(texts) == alone
    assert fingerprints.fingerprints([*texts, "x y z " * 2000])[:-1] == alone
    assert all(p.strip(b"-") for p in alone)
    by_print = defaultdict(set)
    for t, p in zip(texts, alone, strict=True):
        by_print[p].add(t)
    assert sum(len(g) - 1 for g in by_print.values()) <= len(set(texts)) // 20  # equal digits of unlike characters
    for a, b in zip(alone, alone[1:]):
        assert 0 <= fingerprints.likeness(a, b) <= 1 and fingerprints.likeness(a, a) == 1
    assert fingerprints.likeness(b"-" * fingerprints.SAMPLES, b"-" * fingerprints.SAMPLES) == 1


def test_likeness_follows_edits():
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghij "), 6000))
    near, far = list(text), "".join(rng.choice(list("abcdefghij "), 6000))
    for at in sorted(rng.integers(0, 6000, 20), reverse=True):
        near[at : at + 1] = ["xy", "", "z"][at % 3]
    a, b, c = fingerprints.fingerprints([text, "".join(near), far])
    assert fingerprints.likeness(a, b) > 0.7 > 0.3 > fingerprints.likeness(a, c)


def plain_likeness(one, two):
    """Sample by sample, in fractions."""
    agree = reached = Fraction(0)
    for k in range(max(len(one), len(two))):
        a, b = one[k : k + 1] or b"-", two[k : k + 1] or b"-"
        if a != b"-" or b != b"-":
            weight = Fraction(int(fingerprints._WEIGHT[k % fingerprints.SAMPLES]))
            reached += weight
            agree += weight * (a == b)
    return agree / reached if reached else Fraction(int(one == two))


def test_likenesses_equal_sample_by_sample():
    """All ways of comparing agree, for texts of none to many segments; links need nearly equal reaches."""
    rng = np.random.default_rng(8)
    texts = ["", "a", "b", "ab"] + ["".join(rng.choice(list("abcdefghij "), n)) for n in (5, 60, 400, 2048, 2049, 5000, 9000)]
    texts += [edited_copy(rng, t, share) for t in texts[4:] for share in (0.01, 0.05)] + [texts[-1][:7600], "-", "----" * 700]
    prints = fingerprints.fingerprints(texts)
    reach = fingerprints.reach(prints)
    for i, one in enumerate(prints):
        plain = [plain_likeness(one, two) for two in prints]
        assert fingerprints.likenesses([one] * len(prints), prints).tolist() == [float(x) for x in plain]
        assert [fingerprints.likeness(one, two) for two in prints] == [float(x) for x in plain]
        for least in (0.5, 0.8):
            links = [bool(x >= least) for x in plain]
            assert fingerprints.alike_matrix([one], prints, least)[0].tolist() == [x and bool(one) and bool(two) for x, two in zip(links, prints)]
            assert all(min(reach[i], reach[j]) + 1 >= least * max(reach[i], reach[j]) for j, x in enumerate(links) if x)
    assert (fingerprints.alike_matrix(prints, prints, 0.8) == np.array([fingerprints.alike_matrix([p], prints, 0.8)[0] for p in prints])).all()


def test_bands_find_pairs_at_the_threshold():
    """Share of pairs that share a band, by likeness and by number of segments."""
    for seed, n, most, share in ((11, 700, 0.85, 0.95), (12, 1900, 0.85, 0.95), (13, 5000, 0.85, 0.95), (14, 1900, 1.01, 0.97)):
        pairs = near_texts(seed, [n] * 128, 0.8, most)
        prints = [fingerprints.fingerprints([p[i] for p in pairs]) for i in (0, 1)]
        (keys, of), (others, whose) = (fingerprints.band_keys(q, np.array([len(p[i]) for p in pairs])) for i, q in enumerate(prints))
        found = [bool(set(keys[of == k]) & set(others[whose == k])) for k in range(len(pairs))]
        assert len(pairs) >= 20 and np.mean(found) >= share


def brute_pieces(rows):
    from tokenizers import Tokenizer

    encoder, out = Tokenizer.from_file(word_bpe_path()), Counter()
    for i, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def test_packing(spark, folder, odd_docs, no_docs):
    for docs in (documents(spark, folder), odd_docs):
        got = packing.pack_documents(docs, word_bpe_path(), ids=True).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == brute_pieces([(r["doc_id"], r["text"]) for r in docs.collect()])
        bins = defaultdict(list)
        for r in got:
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in bins.values():
            end = 0
            for at, length in sorted(parts):
                assert at == end
                end += length
            assert end <= 2048
        assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 2048 + 2
    assert packing.pack_documents(no_docs, word_bpe_path()).count() == 0


def test_chunk_tokenizer_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["it's I'll  DON'T!! naïve Σίσυφος ΣΑΣ İstanbul", "é café Å", "a b c\x1cd", "12,345.67 x_y <|endoftext|> z", "日本語 текст 😀😀 don't...", "", " \t\n", "word's 'tis (paren) [x] end?!...\n\nx", None]
    encoder, mine = Tokenizer.from_file(word_bpe_path()), packing.ChunkTokenizer(word_bpe_path())
    want = [np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert mine(pa.array(texts)) == want and mine(pa.array(texts)[2:]) == want[2:]


def test_swap_search_improves_on_best_fit():
    rng = np.random.default_rng(8)
    for _ in range(5):
        lengths = rng.integers(500, 1100, 400)
        bins = packing.best_fit(lengths, 2048)
        better = packing.swap_search(lengths, bins, 2048)
        assert len(better) <= len(bins) and sorted(i for b in better for i in b) == list(range(400)) and max(lengths[b].sum() for b in better) <= 2048


def brute_passages(rows):
    words, first = {i: (t or "").encode().split() for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        out[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_passages(spark, folder, odd_docs, no_docs, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    docs = documents(spark, folder)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.drop_repeated_passages(docs).collect()}
    assert got == brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()])
    odd = substrings.drop_repeated_passages(odd_docs).collect()
    want = brute_passages({(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None})
    assert len(odd) == 20 and all((r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]] for r in odd if r["doc_id"] is not None)
    assert all(r["n_removed"] == 0 for r in odd if r["doc_id"] is None)
    assert substrings.drop_repeated_passages(no_docs).count() == 0


def edited_copy(rng, text, share):
    """The text with that share of its characters replaced, taken out or doubled."""
    out = list(text)
    for at in rng.integers(0, len(text), int(share * len(text))):
        out[at] = ["x", "", out[at] * 2][at % 3]
    return "".join(out)


def near_texts(seed, lengths, least, most):
    """(text, copy) for each length where one of 16 copies has a likeness from least to most."""
    rng, pairs = np.random.default_rng(seed), []
    for n in lengths:
        text = "".join(rng.choice(list("abcdefghijklmnop "), n))
        copies = [edited_copy(rng, text, share) for share in np.linspace(0.01, 0.16, 16)]
        print_, *others = fingerprints.fingerprints([text, *copies])
        pairs += [(text, c) for c, o in zip(copies, others) if least <= fingerprints.likeness(print_, o) < most][:1]
    return pairs


def linked_share(spark, pairs):
    """The share of pairs in one class; texts that brute-force likeness keeps apart must be apart."""
    texts = [t for pair in pairs for t in pair]
    prints = fingerprints.fingerprints(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.fingerprint_documents(docs).collect()}
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if fingerprints.likeness(prints[i], prints[j]) >= 0.8}
    assert alike == {(2 * k + 1, 2 * k) for k in range(len(pairs))}
    assert all(got[i] == i or (i, got[i]) in alike for i in got)
    return np.mean([got[i] == got[j] for i, j in alike])


def test_classes_equal_brute_force_likeness(spark):
    assert linked_share(spark, near_texts(1, [1200] * 48, 0.8, 0.88)) >= 0.95


def test_bands_meet_across_lengths():
    """Pairs on both sides of a border of size classes, and the shortest texts, share a band."""
    rng = np.random.default_rng(2)
    pairs = [(t, t[: n // 2] + "xy" + t[n // 2 :]) for n in (361, 511, 723, 1023, 1447, 2047) for t in ["".join(rng.choice(list("abcdefghijklmnop "), n)) for _ in range(8)]]
    pairs += [(t, t[:-1] + "Q") for n in (12, 16, 20) for t in ["".join(rng.choice(list("abcdefghijklmnop "), n)) for _ in range(20)]]
    one, two = (fingerprints.fingerprints([p[i] for p in pairs]) for i in (0, 1))
    (keys, of), (others, whose) = (fingerprints.band_keys(prints, np.array([len(p[i]) for p in pairs])) for i, prints in enumerate((one, two)))
    alike = [k for k in range(len(pairs)) if one[k] == two[k] or fingerprints.likeness(one[k], two[k]) >= 0.8]
    assert len(alike) > 60 and min(len(pairs[k][0]) for k in alike) < 22
    assert np.mean([bool(set(keys[of == k]) & set(others[whose == k])) for k in alike]) >= 0.99


def test_mix_documents_with_odd_columns(spark, odd_docs):
    docs = odd_docs.withColumns({c: F.lit(1) for c in ("target", "draws", "source_size", "source_index", "_key", "_block", "doc")})
    mix = mixing.mix_documents(docs, block=1)
    assert mix.columns[: len(docs.columns)] == docs.columns
    got = mix.collect()
    assert got and all(len(r["text"].encode().split()) == r["mix_words"] and r["n_chars"] == len(r["text"]) and r["size"] == 7 and r["_row"] == "q" for r in got)
    whole = {r["text"] for r in odd_docs.collect()}
    assert any(r["text"] not in whole for r in got)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
See the License for the specific language governing permissions."""
GPL = """This program is free software: you can redistribute it under the terms of the GNU General
Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope
that it will be useful.

You should have received a
copy of the GNU General Public License."""


def test_wrapped_license_notices(spark):
    plain = [MIT, BSD, APACHE, GPL, "This is in the public\ndomain: released into the public\ndomain", "CC0 1.0", "Creative Commons Zero", "SPDX-License-Identifier: MIT\nLicensed under the Apache License, Version 2.0", "My project\nCopyright (c) 2020 Me\nAll rights reserved"]
    want = ["MIT", "BSD-2-Clause", "Apache-2.0", "GPL-3.0-or-later", "Public-Domain", "CC0-1.0", "CC0-1.0", "Apache-2.0,MIT", "All-Rights-Reserved"]
    texts = [mark + t.replace("\n", "\n" + mark) for mark in ("", "# ", " * ", "// ") for t in plain]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_licenses"], r["n_unmatched"]) for r in licenses.digest(licenses.scan(docs)).collect()}
    names = [w for _ in range(4) for w in want]
    assert got == {i: (name, 1 + name.count(","), 0) for i, name in enumerate(names)}


def test_license_words_cover_every_pattern():
    """The shortest texts of each way through a pattern hold a word of the pre-filter."""
    from re import _parser

    def ways(items):
        out = [""]
        for kind, value in items:
            kind = str(kind)
            if kind == "LITERAL":
                more = [chr(value)]
            elif kind == "SUBPATTERN":
                more = ways(value[-1])
            elif kind == "BRANCH":
                more = [w for branch in value[1] for w in ways(branch)]
            elif kind == "MAX_REPEAT":
                more = [w * value[0] for w in ways(value[2])] if value[0] else [""]
            elif kind == "IN":
                more = ["0"]
            else:
                assert kind == "AT"
                more = [""]
            out = [a + b for a in out for b in more]
        return out

    assert all(re.search(licenses.WORDS, w) for _, p in licenses.SENTENCES for w in ways(_parser.parse(p)))


def test_lines_share_keys_by_edit_similarity():
    """Recall of the keys against all pairs by edit similarity alone."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), int(rng.integers(3, 9))))
    found = defaultdict(list)
    for n in (1, 2, 5, 10, 20, 30, 40):
        for _ in range(60):
            line = [word() for _ in range(n)]
            copy = list(line)
            for at in rng.choice(n, max(1, n // 6), replace=False):
                copy[at] = word() if n >= 5 else copy[at][:-1] + "z"
            a, b = " ".join(line), " ".join(copy)
            if a != b and levenshtein(a, b) <= max(len(a), len(b)) * 20 // 100:
                one, two = lines.simhash_blocks([line, ["other"], copy])[[0, 2]]
                found[n].append((one == two).any())
    assert min(map(len, found.values())) >= 10
    assert all(np.mean(found[n]) >= 0.95 for n in found if n >= 5) and np.mean(found[1] + found[2]) >= 0.9


def test_similar_lines_equal_levenshtein():
    """The bounds and the distance by columns of bits against the plain table."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        line = ["".join(rng.choice(list("abc"), int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 12)))]
        other = [w if rng.random() < 0.8 else "".join(rng.choice(list("abc"), int(rng.integers(1, 6)))) for w in line if rng.random() < 0.95] or ["a"]
        a, b = " ".join(line), " ".join(other)
        far = levenshtein(a, b)
        assert lines.similar(a, b, 80) == (far <= max(len(a), len(b)) * 20 // 100)
        assert lines.aligned_cost(line, other) >= far
        assert all(lines.edit_distance_within(a, b, most) == (far <= most) for most in (0, far - 1, far, far + 1))


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    words = ["naïve", "x", "word", "a" * 50, "日本語", "😀b", "word"]
    monkeypatch.setattr(lines, "SLICE", 16)
    plain = [" ".join(words), "word", " ".join(words[::-1])]
    hashes, sizes, of = lines.word_hashes(plain)
    monkeypatch.setattr(lines, "SLICE", 1 << 18)
    many, lengths, whose = lines.word_hashes(plain)
    assert of.tolist() == whose.tolist() == [0] * 7 + [1] + [2] * 7 and sizes.tolist() == lengths.tolist() == [len(w) for w in [*words, "word", *words[::-1]]]
    assert [h for h, n in zip(hashes.tolist(), sizes.tolist()) if n <= 16] == [h for h, n in zip(many.tolist(), lengths.tolist()) if n <= 16]
    assert many[2] == many[6] == many[7] == many[8] and len(set(many.tolist())) == 6
    assert lines.plain_lines("A-b  C\n\n ¿Qué? \n😀\r") == ["a b c", "", "qué", ""]


@pytest.mark.parametrize("n", [8, 12, 20, 30])
def test_line_recall_against_all_pairs(n):
    """Lines of n words with one word replaced, or up to a fifth of their characters changed, against all pairs."""
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), int(rng.integers(2, 10))))
    texts = []
    for k in range(60):
        line = [word() for _ in range(n)]
        copy = list(line)
        for at in rng.choice(n, 1 if k % 2 else max(1, n // 6), replace=False):
            copy[at] = word()
        texts += [" ".join(line), " ".join(copy)]
    blocks, votes = lines.simhashes(texts)
    near = lambda i, j: votes[i] is None or votes[j] is None or ((votes[i] ^ votes[j]) & (2**64 - 1)).bit_count() <= lines.FAR
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if lines.similar(texts[i], texts[j], 80)]
    found = [((blocks[i] == blocks[j]).any() and near(i, j)) for i, j in alike]
    assert len(alike) >= 50 and np.mean(found) >= 0.9


def test_long_secret_candidates(spark):
    """Entropy and places in time linear in the length of a candidate and in the number of matches."""
    rng = np.random.default_rng(0)
    blob = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 100_000))
    many = " ".join(f"token=abc{i:08d}" for i in range(20_000))
    docs = spark.createDataFrame([(1, f"x {blob} y"), (2, many)], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert got[1]["spans"] == "entropy_mixed:2:100002" and got[2]["n_assign"] == 20_000
    assert got[2]["base_sha256"] == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in brute_spans(many)).encode()).hexdigest()
    assert time.monotonic() - began < 60


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it."""
LGPL = """This library is free software; you can redistribute it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
BSD3 = BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors\n   may be used to endorse or promote products."


def test_more_license_notices(spark):
    plain = [MIT, BSD3, APACHE, ZLIB, LGPL, "Licensed under the Eclipse Public License v. 2.0", "the Boost Software License, Version 1.0.", "Artistic License 2.0", "European Union Public Licence v1.2", "Common Development and Distribution License, Version 1.0"]
    want = ["MIT", "BSD-3-Clause", "Apache-2.0", "Zlib", "LGPL-2.1-or-later", "EPL-2.0", "BSL-1.0", "Artistic-2.0", "EUPL-1.2", "CDDL-1.0"]
    texts = plain + [" ".join(t.split()) for t in plain]  # in one line as well
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.digest(licenses.scan(docs)).collect()}
    assert got == dict(enumerate(want + want))


def test_spdx_expressions(spark, tmp_path):
    cases = [
        ("# SPDX-License-Identifier: EPL-2.0", "EPL-2.0", 1, 0),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */", "Apache-2.0,BSD-3-Clause,MIT", 3, 0),
        ("// SPDX-License-Identifier: GPL-2.0-only WITH  Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", 1, 0),
        ("<!-- SPDX-License-Identifier: MIT-->", "MIT", 1, 0),
        ("SPDX-License-Identifier: GPL-2.0+.", "GPL-2.0+", 1, 0),
        ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT\nx = 1", "MIT", 2, 0),
        ("spdx-license-identifier: LicenseRef-own\nLicensed under the Apache License, Version 2.0", "Apache-2.0,LicenseRef-own", 2, 0),
        ("The SPDX license identifier of this", "", 0, 1),
        ("SPDX-License-Identifier:", "", 0, 1),
    ]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(None, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["licenses"], r["n_licenses"], r["n_unmatched"]) for r in licenses.digest(licenses.scan(docs)).collect()}
    assert got == {**{i: c[1:] for i, c in enumerate(cases)}, None: ("", 0, 0)}
    same(queries.op2_license_scan(spark, str(tmp_path)), str(tmp_path), licenses.oracle_sql())


def plain_sentences(text):
    """Identifiers of a text's sentences by the joined rule, one line after the other."""
    text = re.sub(licenses.CLAUSE, r"\1\n\n", re.sub(licenses.BREAK, r"\1\n\n", text or ""))
    known = lambda s: next((n for n, p in licenses.SENTENCES if re.search(p, s)), None)
    found, held = [], ""
    for line in text.split("\n"):
        plain = re.sub("[^a-z0-9]+", " ", line.lower().replace("licence", "license")).strip(" ")
        both = f"{held} {plain}"
        if held and plain and (known(plain) is None or known(both) not in (None, known(plain), known(held))):
            held = both
            continue
        found.append(known(held))
        held = plain
    return [x for x in [*found, known(held)] if x]


def test_licenses_equal_plain_python(spark):
    """Notices cut at random places, with comment marks, blank lines and other lines between."""
    rng = np.random.default_rng(5)
    notices = [MIT, BSD, BSD3, APACHE, GPL, LGPL, ZLIB, "SPDX-License-Identifier: MIT", "All rights reserved", "CC0 1.0"]
    texts = [None, ""]
    for _ in range(150):
        words = " ".join(notices[k] + str(rng.choice([" ", "\n", "\n\n"])) for k in rng.integers(0, len(notices), rng.integers(1, 4))).split(" ")
        texts.append("".join(w + str(rng.choice([" ", "\n", "\n# ", "\n\n", "\nx = 1\n"], p=[0.85, 0.08, 0.04, 0.02, 0.01])) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x["identifier"] for x in r["sentences"]] for r in licenses.scan(docs).collect()}
    assert got == {i: plain_sentences(t) for i, t in enumerate(texts)}


def test_stages_on_empty_tables(spark, no_docs):
    assert lines.drop_repeated_lines(no_docs).count() == minhash.drop_near_duplicates(no_docs).count() == mixing.mix_documents(no_docs).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(no_docs, none).count() == 0


def test_rows_numbered_by_file_place(spark, tmp_path, odd_docs):
    """Operators on stored files, in a folder with odd characters, give what they give on a copied table."""
    path = str(tmp_path / "a b%20c")
    odd_docs.repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = numbered(docs, stored=True).select("row", "doc.doc_id").collect()
    assert len({r["row"] for r in rows}) == len(rows) == 20
    assert sorted(map(str, lines.drop_repeated_lines(docs, stored=True).collect())) == sorted(map(str, lines.drop_repeated_lines(docs).collect()))
    assert sorted(r["doc_id"] or 0 for r in minhash.drop_near_duplicates(docs, stored=True).collect()) == sorted(r["doc_id"] or 0 for r in minhash.drop_near_duplicates(docs).collect())


def test_tidy_leaves_only_the_result(spark):
    kept = []

    @tidy
    def made():
        kept.append(keep(spark.range(3), "first"))
        return keep(kept[0].where("id > 0"), "second")

    assert made().count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(kept[0].kept_at).count()


def test_mix_lies_in_shards(spark, folder):
    drawn = mixing.drawn_documents(documents(spark, folder), block=4, shard_words=20_000)
    rows = mixing.in_shards(drawn).select("mix.shard", "mix.place", F.spark_partition_id().alias("p")).collect()
    assert len({r["shard"] for r in rows}) > 2 and all(len({r["p"] for r in rows if r["shard"] == s}) == 1 for s in {r["shard"] for r in rows})
    assert all((a["shard"], a["place"]) <= (b["shard"], b["place"]) for a, b in zip(rows, rows[1:]) if a["p"] == b["p"])


def test_long_lines_are_aligned():
    """Beyond LONG characters a copy with a few words replaced is similar, one with half of them isn't, and both are quick."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    line = [word() for _ in range(20_000)]
    copy = lambda share: " ".join(word() if rng.random() < share else w for w in line)
    began = time.monotonic()
    assert lines.similar(" ".join(line), copy(0.15), 80) and not lines.similar(" ".join(line), copy(0.5), 80)
    assert time.monotonic() - began < 20
    for _ in range(50):
        one = [word()[: int(rng.integers(1, 6))] for _ in range(12)]
        two = [w if rng.random() < 0.7 else word() for w in one]
        far = levenshtein(" ".join(one), " ".join(two))
        assert far <= lines.aligned_cost(one, two, True) <= lines.aligned_cost(one, two)


def test_votes_are_counted_as_single_bits():
    """Counters of a byte: sets of more than 255 ballots are added up in parts."""
    rng = np.random.default_rng(12)
    sizes = [1, 8, 254, 255, 256, 700, 3]
    ballots = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    ballots[9:] |= np.uint64(1 << 63 | 1)
    starts = np.cumsum([0, *sizes[:-1]])
    expected = [np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0).tolist() for x in np.split(ballots, starts[1:])]
    assert lines.ayes(ballots, starts).tolist() == expected


def test_unlike_lines_are_left_early():
    """The distance of unlike lines is given up where the last diagonal passes the bound, with the same answer."""
    rng = np.random.default_rng(13)
    seen = 0

    class Counted(str):
        def __iter__(self):
            nonlocal seen
            for c in str.__iter__(self):
                seen += 1
                yield c

    one, two = ("".join(rng.choice(list("abcdefghijklmnop "), 2000)) for _ in range(2))
    assert not lines.edit_distance_within(one, Counted(two), 400) and seen < 1200
    for _ in range(200):
        a = "".join(rng.choice(list("abc"), int(rng.integers(1, 60))))
        b = "".join(c for c in a if rng.random() > 0.2) + "".join(rng.choice(list("abc"), int(rng.integers(0, 8))))
        assert all(lines.edit_distance_within(a, b, most) == (levenshtein(a, b) <= most) for most in range(0, 20, 3))


def test_bucket_members_are_dealt_once(spark, monkeypatch):
    """Which members share a bucket is found without a join of all members with the buckets' counts."""
    members = spark.createDataFrame([(b, n, n) for b, held in enumerate([[1], [2, 3], [], [4], [1, 2, 4]]) for n in held], "bucket long, node long, size long")
    monkeypatch.setattr(components, "keep", lambda df, name: df)
    found = components.crowds(members)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2, 2), (1, 3, 3, 2), (4, 1, 1, 3), (4, 2, 2, 3), (4, 4, 4, 3)]


def test_buckets_of_two_are_read_once(spark):
    """The first step compares the pair of a bucket of two, so the later steps deal larger buckets only."""
    shared = spark.createDataFrame([(b, n, 1, len(held)) for b, held in enumerate([[1, 2], [3, 4], [5, 6, 7], [5, 6, 7]]) for n in held], "bucket long, node long, size int, n long")
    asked, opened = [], []

    def verify(pairs):
        asked.append(sorted(map(tuple, pairs.select("a", "b").collect())))
        return pairs.where("a = 1 OR a = 6")

    keep = components.keep
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(components, "keep", lambda df, name: opened.append(df.count()) or keep(df, name) if name == "open" else keep(df, name))
        found = {r["node"]: r["root"] for r in components.linked_within_buckets(shared, verify).collect()}
    assert asked[0] == [(1, 2), (3, 4), (5, 6), (5, 7)] and (6, 7) in sum(asked[1:], []) and len(sum(asked, [])) == 5
    assert found == {1: 1, 2: 1, 6: 6, 7: 6} and max(opened) == 6


def test_pairs_of_several_large_buckets_are_compared_once(spark, tmp_path):
    """Members that share three large buckets, and pairs that share one of them only."""
    buckets = {1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [2, 3, 4, 5]}
    members = spark.createDataFrame([(b, n, n, held[0]) for b, held in buckets.items() for n in held], "bucket long, node long, root long, _pivot long")
    content = spark.createDataFrame([(n, str(n)) for n in range(1, 6)], "node long, content string")
    where = str(tmp_path / "seen")

    def linked(one, two):
        with open(where, "a") as f:
            f.write(f"{min(one, two)}{max(one, two)}\n")
        return one == "5" or two == "5"

    dense = components.Dense(content, str, linked, 1, 2, 2, merge=False)
    found = {tuple(sorted(r)) for r in components.linked_in_blocks(members, dense).collect()}
    assert found == {(2, 5), (3, 5), (4, 5)}
    with open(where) as f:
        assert sorted(f.read().split()) == ["12", "13", "14", "23", "24", "25", "34", "35", "45"]


def test_contents_are_dealt_once(spark, tmp_path):
    spark.range(400).selectExpr("id AS node", "repeat(id, 50) AS content").write.parquet(str(tmp_path / "content"))
    spark.range(399).selectExpr("id AS a", "id + 1 AS b").write.parquet(str(tmp_path / "pairs"))
    with_all = components.with_contents(spark.read.parquet(str(tmp_path / "pairs")), spark.read.parquet(str(tmp_path / "content")).hint("merge"))
    rows = with_all.collect()
    assert len(rows) == 399 and all(r["content_a"] == str(r["a"]) * 50 and r["content_b"] == str(r["b"]) * 50 for r in rows)
    assert "ReusedExchange" in with_all._jdf.queryExecution().executedPlan().toString()


def test_lines_of_few_and_of_many_characters_are_read_alike(spark):
    """Texts of the first 256 characters are read by a shorter way, with the same lines and words."""
    text = "".join(map(chr, range(256))) + "  \x1cÀ_b\tC²\r\n\n \x85x\xa0µ\n"
    assert [*lines.plain_lines(text), "日"] == lines.plain_lines(text + "\n日") and lines.plain_lines("") == [""] and lines.plain_lines("\n") == ["", ""]
    plain = [p for p in lines.plain_lines(text) if p] + ["a" * 9]
    few, many = lines.word_hashes(plain), lines.word_hashes([*plain, "日"])
    assert all(x.tolist() == y[:-1].tolist() for x, y in zip(few, many))
    docs = spark.createDataFrame([(0, "x\nÀ b\r\n\nonly"), (1, "à B!\n日 one\n日 one")], "row long, text string")
    places = spark.createDataFrame([(7, 0, 1, 5), (8, 1, 2, None), (9, 1, 0, 6)], "node long, row long, line int, votes long")
    assert sorted(map(tuple, lines.line_texts(docs, places).collect())) == [(7, "à b", 5), (8, "日 one", None), (9, "à b", 6)]


def test_common_ends_leave_the_edit_similarity():
    rng = np.random.default_rng(14)
    for _ in range(300):
        end = ["".join(rng.choice(list("ab "), int(rng.integers(0, 30)))) for _ in range(2)]
        a, b = (end[0] + "".join(rng.choice(list("ab "), int(rng.integers(0, 25)))) + end[1] for _ in range(2))
        assert lines.common_start(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lines.similar(a, b, 80) == (levenshtein(a, b) <= max(len(a), len(b)) * 20 // 100)


@pytest.mark.parametrize("percent", [80, 100, 55])
def test_many_pairs_of_lines_as_one_by_one(percent):
    """Pairs that are tested at once get the same answers as pairs by themselves, in every class of lengths."""
    rng, texts = random.Random(percent), []
    for letters, n, most in (("ab ", 900, 70), ("abcdefgh\u00e9 ", 500, 150), ("abcde\u4e00\u4e01\U0001f600 ", 300, 400), ("abcdefghijkl ", 60, 2300)):
        for _ in range(n):
            one = "".join(rng.choices(letters, k=rng.randint(0, most)))
            other = list(one)
            for _ in range(rng.randint(0, 1 + len(one) // 2)):
                at = rng.randint(0, len(other))
                other[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
            texts += [one, "".join(other)]
    a = np.arange(0, len(texts), 2)
    b = np.where(np.arange(len(a)) % 3 == 0, np.roll(a, 1), a) + 1
    got = lines.similar_many(texts, a, b, percent)
    want = [max(len(x), len(y)) * (100 - percent) // 100 >= lines.edit_distance(x, y) for x, y in ((texts[i], texts[j]) for i, j in zip(a.tolist(), b.tolist()))]
    assert got.tolist() == want and any(want) and not all(want)


def test_costly_pairs_go_to_all_tasks(spark):
    """Few bytes of text may take long to compare, so Spark doesn't join their parts."""
    content = spark.range(40).selectExpr("id AS node", "struct(repeat('x', 9) AS plain, CAST(NULL AS string) AS votes) AS content")
    pairs = spark.range(39).selectExpr("id AS a", "id + 1 AS b")
    assert components.with_contents(pairs, content, spread=True).rdd.getNumPartitions() == components.tasks(pairs) == 4
    members = spark.range(40).selectExpr("id AS node", "0L AS bucket", "id AS root", "0L AS _pivot")
    many = lambda some, others, a, b: np.ones(len(a), bool)
    dense = components.Dense(content, lines.prepared, lambda a, b: True, merge=False, linked_many=many)
    links = components.linked_in_blocks(members, dense)
    assert links.rdd.getNumPartitions() == 4
    found = [tuple(r) for r in links.collect()]
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert set(roots.values()) == {0} and len(roots) == 40
