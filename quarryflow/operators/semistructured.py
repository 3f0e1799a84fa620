"""Semi-structured columns: nested JSON as variants, flattened level by level, or counted by shape."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryflow.operators.graph import cut

#: Keys that stand in a path without quotes.
PLAIN_KEY = "^[A-Za-z_][A-Za-z0-9_]*$"
#: Levels of members that are looked into.
DEPTH = 64
#: JSON texts that only variants read right: escapes, control characters, fractions, exponents, whole numbers of 19 digits
#: or more, names with index marks; and the length beyond which texts are read as variants too.
ODD, LONG = r"""[\\\x00-\x1f]|[0-9][.eE]|[0-9]{19}|\[[0-9]+\][^"]*"\s*:""", 1_000_000
#: Texts counted, and names remembered, before a task sends its counts on.
HELD, NAMES = 300_000, 100_000


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ... or VOID for a JSON null; null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def has_members(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return (shape.startswith("OBJECT<") & (shape != "OBJECT<>")) | (shape.startswith("ARRAY<") & F.try_variant_get(value, "$[0]", "variant").isNotNull())


def member_list(value: Column, depth: int) -> Column:
    """An array of (path, key, index, kind, text, value): all members of a variant and, down to depth levels, of its members.

    One expression a row, so nothing is written between levels, but slower than flatten() by far: for few odd values.
    """
    as_array = lambda v: F.try_variant_get(v, "$", "array<variant>").alias("items")
    as_map = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")).alias("entries")

    def item(path: Column, v: Column, i: Column) -> Column:
        return F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.lit(None).cast("string").alias("key"), i.alias("index"), v.alias("value"), as_array(v), as_map(v))

    def entry(path: Column, key: Column, v: Column) -> Column:
        name = F.when(key.rlike(PLAIN_KEY), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('."'), F.replace(key, F.lit('"'), F.lit('\\"')), F.lit('"')))
        return F.struct(F.concat(path, name).alias("path"), key.alias("key"), F.lit(None).cast("int").alias("index"), v.alias("value"), as_array(v), as_map(v))

    def children(path: Column, items: Column, entries: Column) -> Column:
        held = F.transform(items, lambda v, i: item(path, v, i))
        return F.when(items.isNotNull(), held).otherwise(F.transform(entries, lambda e: entry(path, e["key"], e["value"])))

    def deeper(state: Column) -> Column:
        held = F.filter(state["front"], lambda m: m["items"].isNotNull() | m["entries"].isNotNull())
        return F.struct(F.concat(state["found"], state["front"]).alias("found"), F.flatten(F.transform(held, lambda m: children(m["path"], m["items"], m["entries"]))).alias("front"))

    def finished(m: Column) -> Column:
        kind = F.when(m["items"].isNotNull(), "ARRAY").when(m["entries"].isNotNull(), "OBJECT").otherwise(kind_of(m["value"]))
        text = F.when(m["items"].isNull() & m["entries"].isNull(), F.try_variant_get(m["value"], "$", "string"))
        return F.struct(m["path"].alias("path"), m["key"].alias("key"), m["index"].alias("index"), kind.alias("kind"), text.alias("text"), m["value"].alias("value"))

    top = children(F.lit("$"), as_array(value), as_map(value))
    start = F.struct(F.slice(top, 1, 0).alias("found"), top.alias("front"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, lambda state, _: F.when(F.size(state["front"]) > 0, deeper(state)).otherwise(state), lambda state: state["found"])
    return F.transform(walk, finished)


def flatten(df: DataFrame, column: str, keep: Sequence[str], recursive: bool = True, outer: bool = False, depth: int = 64) -> DataFrame:
    """keep, path, key, index, kind, text, value: a row for each member of objects and arrays in column.

    column holds JSON text or variants; text that isn't JSON counts as null. path begins with $, key is an object's
    member name, index a place in an array; text is a scalar's text, null for objects, arrays and JSON nulls. recursive:
    members of members as well, down to depth levels. outer: rows without members give one row with nulls.
    """
    if df.schema[column].dataType.typeName() != "variant":
        df = df.withColumn(column, F.try_parse_json(F.col(column).cast("string")))
    spark = df.sparkSession
    level = df.select(F.struct(*keep).alias("_row"), F.lit("$").alias("path"), F.col(column).alias("value"))
    found = None
    for k in range(depth):
        step = spark.sql("SELECT _row, path, e.key AS key, e.pos AS pos, e.value AS member FROM {level} JOIN LATERAL variant_explode(value) AS e", level=level)
        name = F.when(F.col("key").rlike(PLAIN_KEY), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('."'), F.replace("key", F.lit('"'), F.lit('\\"')), F.lit('"')))
        path = F.concat("path", F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(name))
        step = step.select("_row", path.alias("path"), "key", F.when(F.col("key").isNull(), F.col("pos")).alias("index"), kind_of(F.col("member")).alias("kind"), F.col("member").alias("value"))
        if recursive:
            step = cut(step)
        if outer and not k:
            bare = [F.lit(None).cast(f.dataType).alias(f.name) for f in step.schema.fields[1:]]
            step = step.union(level.where(~F.coalesce(has_members(F.col("value")), F.lit(False))).select("_row", *bare))
        found = step if found is None else found.union(step)
        level = step.where("kind IN ('OBJECT', 'ARRAY')").select("_row", "path", "value")
        if not recursive or level.isEmpty():
            break
    text = F.when(~F.col("kind").isin("OBJECT", "ARRAY"), F.try_variant_get("value", "$", "string"))
    return found.select("_row.*", "path", "key", "index", "kind", text.alias("text"), "value")


def plain_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, text, n, last, owner, odd: members of texts of JSON by kind and path (at) and text, counted as they are read.

    batches: lists of texts, one an owner; rows of owner count the owners that have such a member. Lists with a text that
    isn't plain, or that json doesn't read, come out as they are, as odd.
    """
    kinds = {str: "STRING", bool: "BOOLEAN", int: "BIGINT", type(None): "VOID", dict: "OBJECT", list: "ARRAY"}
    counts: dict[tuple, list] = {}
    names: dict[tuple, str] = {}

    def add(value, path: str, index: int | None, depth: int) -> None:  # noqa: ANN001
        kind = type(value)
        at = kinds[kind] + path
        seen.add(at)
        text = value if kind is str else None if kind is dict or kind is list or value is None else ("true" if value else "false") if kind is bool else str(value)
        held = counts.get((at, text))
        if held is None:
            counts[at, text] = [1, index]
        else:
            held[0] += 1
            if index is not None and (held[1] is None or index > held[1]):
                held[1] = index
        if depth > 1 and (kind is dict or kind is list):
            walk(value, path, depth - 1)

    def walk(value, path: str, depth: int) -> None:  # noqa: ANN001
        if type(value) is dict:
            for key, member in value.items():
                here = names.get((path, key))
                if here is None:
                    here = path + ("." + key if re.fullmatch(PLAIN_KEY, key) else '."' + key + '"')
                    if len(names) < NAMES:
                        names[path, key] = here
                add(member, here, None, depth)
        elif type(value) is list:
            for i, member in enumerate(value):
                add(member, path + "[*]", i, depth)

    def out(odd: list) -> pa.RecordBatch:
        rows = [(at, text, n, last, False, None) for (at, text), (n, last) in counts.items()]
        rows += [(at, None, n, None, True, None) for at, n in owners.items()] + [(None, None, None, None, None, texts) for texts in odd]
        types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["at", "text", "n", "last", "owner", "odd"])

    owners: Counter = Counter()
    for batch in batches:
        odd = []
        for texts, plain in zip(batch.column("texts").to_pylist(), batch.column("plain").to_pylist(), strict=True):
            try:
                values = [json.loads(text, object_pairs_hook=_object, parse_constant=_none) for text in texts] if plain else None
            except (ValueError, RecursionError):  # whether it is JSON is for variants to say
                values = None
            if values is None:
                odd.append(texts)
                continue
            seen: set[str] = set()
            for value in values:
                walk(value, "$", DEPTH)
            owners.update(seen)
        if odd or len(counts) > HELD:
            yield out(odd)
            counts.clear()
            owners.clear()
    yield out([])


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a name twice")
    return found


def _none(name: str) -> None:
    raise ValueError(name)


def member_shapes(df: DataFrame, column: str, by: str) -> DataFrame:
    """shape, kind, n, owners, texts, last_index, least, letters: members of all JSON texts by path (any index) and kind.

    owners: distinct values of by that have such a member; texts: distinct texts; least: the least of them; letters:
    their length, repeats counted. Texts of one owner are read together, and members are counted where they are read;
    what is shuffled are distinct texts of shapes with their counts. Texts whose numbers, marks or size variants treat
    in their own way (ODD) are read as variants. Index marks within names count as marks of an index.
    """
    value = F.col(column).cast("string")
    owned = df.where(F.col(by).isNotNull() & value.isNotNull()).select(by, value.alias("_text")).groupBy(by).agg(F.collect_list("_text").alias("texts"))
    owned = owned.select("texts", (~F.exists("texts", lambda v: v.rlike(ODD) | (F.length(v) > LONG))).alias("plain"))
    read = owned.mapInArrow(plain_shapes, "at string, text string, n long, last int, owner boolean, odd array<string>")

    shaped = lambda m: F.concat(m["kind"], F.regexp_replace(m["path"], r"\[\d+\]", "[*]"))
    row = lambda at, text, n, last, owner: F.struct(at.alias("at"), text.alias("text"), n.alias("n"), last.alias("last"), owner.alias("owner"))
    members = F.flatten(F.transform("odd", lambda v: F.coalesce(F.transform(member_list(F.try_parse_json(v), DEPTH), lambda m: row(shaped(m), m["text"], F.lit(1).cast("long"), m["index"], F.lit(False))), F.array())))
    none, one = F.lit(None), F.lit(1).cast("long")
    with_marks = lambda found: F.concat(found, F.transform(F.array_distinct(F.transform(found, lambda m: m["at"])), lambda a: row(a, none.cast("string"), one, none.cast("int"), F.lit(True))))
    each = F.when(F.col("odd").isNull(), F.array(row(*(F.col(c) for c in ("at", "text", "n", "last", "owner"))))).otherwise(F.flatten(F.transform(F.array(members), with_marks)))
    rows = read.select(F.explode(each).alias("m")).select("m.*")

    texts = rows.groupBy("at", "owner", "text").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    found = texts.groupBy("at").agg(
        F.sum(F.when(~F.col("owner"), F.col("n"))).alias("n"), F.sum(F.when(F.col("owner"), F.col("n"))).alias("owners"), F.count("text").alias("texts"),
        F.max("last").cast("long").alias("last_index"), F.min("text").alias("least"), F.sum(F.col("n") * F.length("text")).alias("letters"),
    )
    place = F.instr("at", "$")
    return found.select(F.substring("at", place, F.length("at")).alias("shape"), F.substring("at", F.lit(1), place - 1).alias("kind"), "n", "owners", "texts", "last_index", "least", "letters")


def map_members(df: DataFrame, column: str, keep: Sequence[str], kind: str = "string") -> DataFrame:
    """keep, key, value: the members of a JSON object as a map of one type; members of other types are null values."""
    held = F.from_json(F.col(column).cast("string"), "map<string,string>")
    return df.select(*keep, F.explode(held).alias("key", "value")).withColumn("value", F.col("value").try_cast(kind))
