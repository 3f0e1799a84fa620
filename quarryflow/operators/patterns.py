"""Row pattern matching: a regular expression over the rows of each partition in order, as MATCH_RECOGNIZE does.

Each row has a symbol, one character. Rows of a partition lie in buckets of time as wide as the longest match, and each
bucket also holds the rows of the next one, so every match that begins in a bucket is found within it; a partition with
very many rows is many groups. The matches that overlap are settled afterwards between matches, not rows: one that no
earlier match reaches into is taken for sure, and what follows from those is found by doubling pointers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.operators.graph import cut


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column).cast("timestamp"))


def cell(value: Column, width: int) -> Column:
    """The number of the cell of so many units that a whole number lies in; exact for any long."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def match_rows(rows: DataFrame, partition: Sequence[str], order: str, ties: Sequence[str], symbol: Column, pattern: str, within: float, keep: Sequence[str], overlapping: bool = False) -> DataFrame:
    """One row a match: the partition's columns, start_us, end_us, symbols and matched (array of structs of keep).

    order is a timestamp; rows of equal time follow each other by ties. A match from a row is what pattern, a regular
    expression over symbols, prefers among the rows that lie at most within seconds after it. Matches are taken from the
    first row on, each after the last row of the one before (overlapping: from every row). Rows without a time are left
    out, null partitions are one partition, a null symbol is "_", empty matches are none.
    """
    span = max(1, round(within * 1_000_000))
    key = F.struct(F.col("_us"), *(F.col(f"_row.`{c}`").alias(f"t{k}") for k, c in enumerate(ties)), F.col("_id"))
    rows = rows.where(F.col(order).isNotNull())
    base = rows.select(F.struct(*partition).alias("_p"), micros(rows, order).alias("_us"), F.struct(*rows.columns).alias("_row"), F.coalesce(symbol, F.lit("_")).alias("sym"), F.monotonically_increasing_id().alias("_id"))
    base = base.select("_p", "_us", key.alias("k"), "sym", F.struct(*(F.col(f"_row.`{c}`").alias(c) for c in keep)).alias("row"), cell(F.col("_us"), span).alias("_own"))
    dealt = base.withColumn("_b", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    near = Window.partitionBy("_p", "_b").orderBy("_us").rangeBetween(Window.unboundedPreceding, span)
    dealt = dealt.withColumn("last", F.count("*").over(near))
    groups = dealt.groupBy("_p", "_b").agg(F.sort_array(F.collect_list(F.struct("k", "sym", "last", (F.col("_b") == F.col("_own")).alias("own"), "row"))).alias("a"))
    groups = groups.withColumn("s", F.array_join(F.transform("a", lambda x: x["sym"]), ""))

    def found(x: Column, i: Column) -> Column:
        text = F.when(x["own"], F.regexp_extract(F.substr(F.col("s"), i + 1, (x["last"] - i).cast("int")), f"^(?:{pattern})", 0)).otherwise("")
        return F.struct(x["k"].alias("start"), i.alias("at"), text.alias("symbols"))

    def whole(c: Column) -> Column:
        slice_ = F.slice(F.col("a"), c["at"] + 1, F.length(c["symbols"]))
        return F.struct(c["start"].alias("start"), F.element_at(slice_, -1)["k"].alias("end"), c["symbols"].alias("symbols"), F.transform(slice_, lambda x: x["row"]).alias("matched"))

    matches = groups.select("_p", F.explode(F.transform(F.filter(F.transform("a", found), lambda c: c["symbols"] != ""), whole)).alias("m")).select("_p", "m.*")
    matches = cut(matches)
    if not overlapping:
        matches = matches.join(_taken(matches, span), F.col("start._id") == F.col("_taken"), "left_semi")
    return matches.select("_p.*", F.col("start._us").alias("start_us"), F.col("end._us").alias("end_us"), "symbols", "matched")


def _taken(matches: DataFrame, span: int) -> DataFrame:
    """_taken: the ids of the first rows of the matches that stay when each begins after the last row of the one before."""
    ends = matches.select("_p", "start", "end", F.col("start._id").alias("id"), cell(F.col("start._us"), span).alias("own"), cell(F.col("end._us"), span).alias("last"))
    # a match that reaches a later one's first row begins in the same bucket or the one before
    before = Window.partitionBy("_p", "_b").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    both = ends.withColumn("_b", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("_reached", F.max("end").over(before))
    marked = cut(both.where("_b = own").select("_p", "start", "end", "id", "own", "last", (F.col("_reached").isNull() | (F.col("_reached") < F.col("start"))).alias("free")))
    taken = marked.where("free").select(F.col("id").alias("_taken"))
    if marked.where("NOT free").isEmpty():
        return taken
    # the first match after each match's last row: behind it in its bucket or in the next
    starts = marked.select("_p", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("_b"), F.col("start").alias("k"), F.lit(1).alias("kind"), F.struct("id", "free").alias("to"), F.lit(None).cast("long").alias("id"))
    stops = marked.select("_p", F.col("last").alias("_b"), F.col("end").alias("k"), F.lit(0).alias("kind"), F.lit(None).cast(starts.schema["to"].dataType).alias("to"), "id")
    after = Window.partitionBy("_p", "_b").orderBy(F.desc("k"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    jump = starts.union(stops).withColumn("next", F.last("to", ignorenulls=True).over(after)).where("kind = 0 AND NOT next.free").select("id", F.col("next.id").alias("next"))
    jump = cut(jump)
    while not jump.isEmpty():
        taken = cut(taken.union(taken.join(jump, F.col("_taken") == F.col("id")).select(F.col("next").alias("_taken"))).distinct())
        then = jump.select(F.col("id").alias("_via"), F.col("next").alias("_next"))
        jump = cut(jump.join(then, F.col("next") == F.col("_via")).select("id", F.col("_next").alias("next")))
    return taken
