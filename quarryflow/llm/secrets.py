"""Secret scan: known shapes, and sliding-window Shannon entropy by character class (operator 3).

Everything is DataFrame and SQL functions. Spark's regular expressions give matches but no places; splitting the text
by the same pattern gives what lies between them, and the lengths of both, summed, are the places.

Base shapes are assignments, access keys and long hexadecimal runs. The entropy scan adds spans of kinds entropy_hex
and entropy_mixed: candidate strings of 20 or more letters, digits and +/_=- that hold a window of 20 characters with
high entropy. A window's counts follow from the one before by one character in and one out. The allow-list suppresses
candidates of letters alone or digits alone, UUIDs, placeholders, and what overlaps a base span.

Defined cases: null text counts as empty; no spans give the SHA-256 of the empty string and an empty spans string;
repeated rows, null doc_ids and empty tables pass through; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes, with the group that must be long enough and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: The allow-list.
ALLOWED = (r"^[A-Za-z/_=+-]*$", r"^[0-9/_=+-]*$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"(?i)example|placeholder|changeme|dummy|xxxx|0000000000|1234567890")

WINDOW = 20
#: Matches placed in one pass.
CHUNK = 512
#: Least bits a character in some window.
LEAST_HEX = 3.05
LEAST_MIXED = 3.75
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it: inside a lambda, a name is a reference."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start,end,value>> of a pattern's leftmost, non-overlapping matches; group must have least characters.

    Matches are placed in chunks of CHUNK, whose starts follow from the lengths of the chunks before: appending to one
    array copies it, so a single pass over n matches would copy n * n / 2 of them.
    """
    p = F.lit(pattern)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def rows(found: Column) -> Column:
        values = F.regexp_extract_all(text, p, F.lit(group)) if group else found
        return F.transform(F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("found"), values.alias("value")), lambda r: F.struct(F.length(r["gap"]).alias("gap"), F.length(r["found"]).alias("size"), r["value"].alias("value")))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        end = start + row["size"]
        one = F.array(F.struct(start.alias("start"), end.alias("end"), row["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.when(F.length(row["value"]) >= least, one).otherwise(empty)).alias("spans"))

    def chunk_starts(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, r: n + r["gap"] + r["size"]))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda starts, n: F.concat(starts, F.array(F.element_at(starts, -1) + n)))

    def placed(chunks: Column) -> Column:
        spans = F.transform(F.arrays_zip(chunks.alias("chunk"), chunk_starts(chunks).alias("start")), lambda c: F.aggregate(F.coalesce(c["chunk"], F.array().cast("array<struct<gap:int,size:int,value:string>>")), F.struct(c["start"].alias("at"), empty.alias("spans")), step, lambda state: state["spans"]))
        return F.flatten(spans)

    chunked = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int")), lambda c: F.slice(r, c * CHUNK + 1, F.lit(CHUNK)))
    spans = let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: let(rows(found), lambda r: let(chunked(r), placed)))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def most_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits a character, of the windows of a string of at least window characters.

    The state holds the counts of the string's distinct characters and the sum of count * log2(count); a step takes one
    character in and one out, so the cost is linear in the string's length.
    """

    def folded(letters: Column, kinds: Column, weight: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            return let(F.struct(F.get(letters, i).alias("enters"), F.when(i >= window, F.get(letters, i - window)).alias("leaves")), lambda x: moved(state, i, x["enters"], x["leaves"]))

        def moved(state: Column, i: Column, enters: Column, leaves: Column) -> Column:
            same = F.coalesce(enters == leaves, F.lit(False))
            entered = F.get(state["counts"], F.array_position(kinds, enters).cast("int") - 1)
            left = F.get(state["counts"], F.array_position(kinds, leaves).cast("int") - 1)
            gained = F.get(weight, entered + 1) - F.get(weight, entered)
            lost = F.coalesce(F.get(weight, left) - F.get(weight, left - 1), F.lit(0.0))
            counts = F.zip_with(kinds, state["counts"], lambda kind, n: n + (kind == enters).cast("int") - F.coalesce((kind == leaves).cast("int"), F.lit(0)))
            return let(F.when(same, state["total"]).otherwise(state["total"] + gained - lost), lambda total: F.struct(F.when(same, state["counts"]).otherwise(counts).alias("counts"), total.alias("total"), F.greatest(state["most"], F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(0.0)).alias("most")))

        start = F.struct(F.transform(kinds, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("most"))
        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step, lambda state: state["most"])

    weights = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    return let(F.split(value, ""), lambda letters: let(F.array_distinct(letters), lambda kinds: let(weights, lambda weight: folded(letters, kinds, weight))))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and arrays of spans (start, end, value) by kind: assign, access, hex and entropy."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.select("doc_id", matches(F.col("text"), ASSIGN, 2, 6).alias("assign"), matches(F.col("text"), ACCESS).alias("access"), matches(F.col("text"), HEX).alias("hex"), matches(F.col("text"), CANDIDATE).alias("_candidates"))
    base = F.concat("assign", "access", "hex")
    allowed = lambda c: reduce(lambda a, b: a | b, (c["value"].rlike(p) for p in ALLOWED))
    open_ones = F.filter("_candidates", lambda c: ~allowed(c) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    df = df.withColumn("_candidates", open_ones)
    is_hex = lambda c: c["value"].rlike("^[0-9a-fA-F]+$")
    measured = F.transform("_candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), F.when(is_hex(c), "entropy_hex").otherwise("entropy_mixed").alias("kind"), most_entropy(c["value"]).alias("bits")))
    df = df.withColumn("_measured", F.when(F.size("_candidates") > 0, measured))
    least = lambda c: F.when(c["kind"] == "entropy_hex", LEAST_HEX).otherwise(LEAST_MIXED)
    entropy = F.coalesce(F.filter("_measured", lambda c: c["bits"] >= least(c)), F.array().cast("array<struct<start:int,end:int,value:string,kind:string,bits:double>>"))
    return df.select("doc_id", "assign", "access", "hex", entropy.alias("entropy"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by kind as listed."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    of = lambda kind, rank: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end")))
    base = F.concat(*(of(kind, lambda s, k=k: F.lit(k)) for k, kind in enumerate(KINDS[:3])))
    df = found.withColumn("_base", base).withColumn("_more", of("entropy", lambda s: F.when(s["kind"] == "entropy_hex", 3).otherwise(4)))
    return df.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.concat("_base", "_more")).alias("spans"),
    )


def oracle_sql() -> str:
    """The digest in DuckDB SQL, from the same fixed values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def spans(pattern: str, group: int, least: int, rank: str) -> str:
        p = quote(pattern)
        lengths = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
        start = f"{lengths.format('z.gaps[1:i]')} + {lengths.format('z.found[1:i - 1]')}"
        one = f"{{s: CAST({start} AS BIGINT), r: {rank}, e: CAST({start} + length(z.found[i]) AS BIGINT), v: z.vals[i]}}"
        z = f"(SELECT {{gaps: regexp_split_to_array(t, {p}), found: regexp_extract_all(t, {p}, 0), vals: regexp_extract_all(t, {p}, {group})}})"
        return f"(SELECT list_filter(list_transform(range(1, len(z.found) + 1), lambda i: {one}), lambda y: length(y.v) >= {least}) FROM (SELECT {z} AS z))"

    text = lambda column: f"coalesce(array_to_string(list_transform(list_sort({column}), lambda y: [{', '.join(map(quote, KINDS))}][y.r + 1] || ':' || y.s || ':' || y.e), ','), '')"
    allowed = " OR ".join(f"regexp_matches(q.v, {quote(p)})" for p in ALLOWED)
    bits = f"list_max(list_transform(range(1, length(q.v) - {WINDOW - 2}), lambda i: list_entropy(string_split(substring(q.v, i, {WINDOW}), ''))))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {spans(ASSIGN, 2, 6, "0")} AS a, {spans(ACCESS, 0, 0, "1")} AS k, {spans(HEX, 0, 0, "2")} AS h, {spans(CANDIDATE, 0, 0, "3")} AS c FROM d),
b AS (SELECT *, list_concat(a, k, h) AS base FROM f),
o AS (SELECT *, list_filter(c, lambda q: NOT ({allowed}) AND len(list_filter(base, lambda y: y.s < q.e AND q.s < y.e)) = 0) AS open_ones FROM b),
m AS (SELECT *, list_filter(list_transform(open_ones, lambda q: {{s: q.s, r: CASE WHEN regexp_matches(q.v, '^[0-9a-fA-F]+$') THEN 3 ELSE 4 END, e: q.e, bits: {bits}}}), lambda q: q.bits >= CASE WHEN q.r = 3 THEN {LEAST_HEX} ELSE {LEAST_MIXED} END) AS more FROM o),
s AS (SELECT *, list_transform(base, lambda y: {{s: y.s, r: y.r, e: y.e}}) AS bs, list_transform(more, lambda y: {{s: y.s, r: y.r, e: y.e}}) AS ms FROM m)
SELECT doc_id, len(a) AS n_assign, len(k) AS n_access, len(h) AS n_hex, sha256({text("bs")}) AS base_sha256, {text("list_concat(bs, ms)")} AS spans FROM s"""
