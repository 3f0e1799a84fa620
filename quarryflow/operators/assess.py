"""Assessment of SQL objects, a table (path, source_sql, ...): class, name, measures, features, risk, lineage.

All are columns over source_sql, so a repository of any size is one scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryflow.operators.graph import cut

#: Counts taken from the text, by pattern.
MEASURES = (
    ("ctes", r"(?i)\bWITH\b"),
    ("joins", r"(?i)\bJOIN\b"),
    ("subqueries", r"(?i)\(\s*SELECT\b"),
    ("window_functions", r"(?i)\bOVER\s*\("),
    ("aggregations", r"(?i)\b(?:SUM|COUNT|AVG|MIN|MAX)\s*\("),
    ("case_expressions", r"(?i)\bCASE\b"),
    ("temp_tables", r"(?i)CREATE\s+(?:LOCAL\s+)?TEMP"),
    ("dynamic_sql", r"(?i)EXECUTE\s+IMMEDIATE|EXEC\s*\("),
    ("cursors", r"(?i)\bCURSOR\b"),
)

#: A measure at or over its threshold adds points.
POINTS = (("ctes", 20, 10), ("joins", 30, 12), ("subqueries", 15, 8), ("window_functions", 10, 6), ("temp_tables", 5, 10), ("dynamic_sql", 1, 20), ("cursors", 1, 18))

#: Points by object type; others 5.
TYPE_POINTS = {"stored_procedure": 15, "function": 10, "view": 3, "table": 2, "sql_script": 5, "temp_table": 4}

#: Features by source dialect that Spark SQL doesn't take as they are.
FEATURES = {
    "vertica": (("PROJECTION", r"\bPROJECTION\b"), ("SEGMENTED BY", r"\bSEGMENTED\s+BY\b"), ("ENCODED BY", r"\bENCODED\s+BY\b"), ("PARTITION BY (Vertica)", r"\bPARTITION\s+BY\s+\w+\s+GROUP\s+BY"), ("ISNULL (Vertica)", r"\bISNULL\s*\("), ("ZEROIFNULL", r"\bZEROIFNULL\s*\("), ("NVL (Oracle-style in Vertica)", r"\bNVL\s*\("), ("TIMESERIES", r"\bTIMESERIES\b"), ("INTERPOLATE", r"\bINTERPOLATE\b")),
    "oracle": (("CONNECT BY", r"\bCONNECT\s+BY\b"), ("ROWNUM", r"\bROWNUM\b"), ("DUAL table", r"\bFROM\s+DUAL\b"), ("PL/SQL block", r"\bBEGIN\b.*\bEND\b"), ("EXCEPTION handler", r"\bEXCEPTION\s+WHEN\b"), ("PACKAGE", r"\bCREATE\s+(?:OR\s+REPLACE\s+)?PACKAGE\b")),
    "redshift": (("DISTSTYLE", r"\bDISTSTYLE\b"), ("DISTKEY", r"\bDISTKEY\b"), ("SORTKEY", r"\bSORTKEY\b"), ("SUPER type", r"\bSUPER\b"), ("Spectrum external", r"\bSPECTRUM\b|\bEXTERNAL\s+SCHEMA\b")),
    "bigquery": (("ARRAY/STRUCT", r"\b(?:ARRAY|STRUCT)\s*<"), ("QUALIFY", r"\bQUALIFY\b"), ("SCRIPTING DECLARE", r"\bDECLARE\s+\w+\s+(?:INT64|STRING|BOOL|FLOAT64)\b"), ("SAFE. functions", r"\bSAFE\.\w+")),
    "snowflake": (("VARIANT/OBJECT", r"\b(?:VARIANT|OBJECT|ARRAY)\b"), ("FLATTEN", r"\bFLATTEN\s*\("), ("MATCH_RECOGNIZE", r"\bMATCH_RECOGNIZE\b"), ("JavaScript procedure", r"\bLANGUAGE\s+JAVASCRIPT\b")),
}

#: Where a statement writes.
WRITES = (
    r"(?i)INSERT\s+INTO\s+([\w.]+)",
    r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:LOCAL\s+TEMP\s+|TEMP\s+|TEMPORARY\s+)?TABLE\s+([\w.]+)",
    r"(?i)MERGE\s+INTO\s+([\w.]+)",
    r"(?i)UPDATE\s+([\w.]+)\s+SET",
    r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+([\w.]+)",
)
READS = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][\w.]*)"
CTE_NAMES = r"(?i)(?:\bWITH\s+|,\s*)([A-Za-z_]\w*)\s+AS\s*\("

#: What happens to a column, by pattern; {c} is its name.
TRANSFORMS = (
    ("aggregation", r"\b(?:SUM|COUNT|AVG|MIN|MAX)\s*\([^)]*{c}"),
    ("case_logic", r"\bCASE\b[\s\S]*?{c}"),
    ("window_function", r"{c}[^)]*\bOVER\s*\("),
    ("cast", r"CAST\s*\(\s*{c}"),
    ("coalesce", r"\b(?:COALESCE|NVL|IFNULL|ZEROIFNULL)\s*\([^)]*{c}"),
    ("date_trunc", r"\b(?:DATE_TRUNC|TRUNC)\s*\([^)]*{c}"),
)

#: The same patterns as parts of a text that hold or begin with the column: the pattern of a part, and whether
#: the column begins it. A part is found once a text, in one pass over it, for all columns.
PARTS = {
    "aggregation": (r"\b(?:SUM|COUNT|AVG|MIN|MAX)\s*\(([^)]*)", False),
    "case_logic": (r"\bCASE\b([\s\S]*)", False),
    "window_function": (r"(?:^|\))([^)]*)\bOVER\s*\(", False),
    "cast": (r"CAST\s*\(\s*(?=(\w*))", True),
    "coalesce": (r"\b(?:COALESCE|NVL|IFNULL|ZEROIFNULL)\s*\(([^)]*)", False),
    "date_trunc": (r"\b(?:DATE_TRUNC|TRUNC)\s*\(([^)]*)", False),
}
#: Stands before each part; no column's name holds it.
MARK = "\x00"


#: Class of an object by what its upper-case text holds; the first row that holds counts.
TYPES = (
    ("stored_procedure", ("CREATE OR REPLACE PROCEDURE", "CREATE PROCEDURE")),
    ("function", ("CREATE OR REPLACE FUNCTION", "CREATE FUNCTION")),
    ("view", ("CREATE VIEW", "CREATE OR REPLACE VIEW")),
    ("table", ("CREATE TABLE", "CREATE LOCAL TEMP")),
)
#: Class of other files by the end of their lower-case path, and what the text must hold, as it is or in lower case.
FILE_TYPES = ((r"\.ya?ml$", "models:", None, "dbt_model"), (r"\.py$", "DAG(", "airflow", "airflow_dag"), (r"\.sql$", None, None, "sql_script"))

#: Where an object's name stands.
NAMES = (r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION)\s+([\w.]+)", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+([\w.]+)", r"(?i)CREATE\s+(?:LOCAL\s+TEMP|TEMP|TEMPORARY)?\s*TABLE\s+([\w.]+)")

#: Points of a number that is over the first value; the first row that holds counts.
LINE_POINTS, DEPENDENCY_POINTS, DOWNSTREAM_POINTS = ((2000, 25), (500, 12), (100, 5)), ((10, 10), (3, 4)), ((5, 12), (0, 3))
#: Level, category and action by score, at or over the first value.
LEVELS = ((75, "critical"), (50, "high"), (25, "medium"))
CATEGORIES = ((80, "manual_redesign"), (55, "partial"), (30, "auto_with_review"))
ACTIONS = ((80, "manual_redesign"), (60, "rewrite"), (35, "review_and_migrate"))
#: Temporary tables under this score are retired; more reviews than this ask for a review.
RETIRED_BELOW, REVIEWS = 30, 3

#: How a script loads its table, by what its upper-case text holds: all of these, and one of those.
LOADS = (("Delete and reload", ("DELETE FROM", "INSERT INTO"), ()), ("Timestamp-based incremental load", ("WHERE",), ("LOAD_DATE", "UPDATED_AT")), ("Merge/upsert", ("MERGE INTO",), ()))

#: Differences of behaviour: name, source and target platform, pattern of the text, severity.
BEHAVIORS = (
    ("empty_string_vs_null", "oracle", "snowflake", r"''|EMPTY", "high"),
    ("empty_string_vs_null_vertica", "vertica", "snowflake", r"=\s*''|<> ''|IS NULL", "medium"),
    ("integer_division", "vertica", "snowflake", r"/\s*\d+|/\s*\w+", "medium"),
    ("case_sensitivity", "vertica", "snowflake", r'"[^"]+"', "high"),
    ("timezone_behavior", "vertica", "snowflake", r"TIMESTAMP|TIMEZONE|AT TIME ZONE", "high"),
    ("date_trunc_semantics", "vertica", "snowflake", r"DATE_TRUNC|TRUNC\s*\(", "medium"),
    ("floating_point_precision", "vertica", "snowflake", r"\bFLOAT\b|\bDOUBLE\b|\bREAL\b", "medium"),
    ("default_ordering", "vertica", "snowflake", r"SELECT(?!.*ORDER BY)", "low"),
    ("merge_semantics", "vertica", "snowflake", r"\bMERGE\s+INTO\b", "high"),
    ("boolean_handling", "vertica", "snowflake", r"\bBOOLEAN\b|=\s*[01]\s", "medium"),
    ("zeroifnull_isnull", "vertica", "snowflake", r"ZEROIFNULL|ISNULL|NVL", "medium"),
    ("sequence_handling", "oracle", "snowflake", r"\bSEQUENCE\b|\.NEXTVAL|AUTO_INCREMENT", "low"),
    ("rownum_vs_qualify", "oracle", "snowflake", r"\bROWNUM\b", "high"),
    ("redshift_encoding", "redshift", "snowflake", r"\b(DISTKEY|SORTKEY|DISTSTYLE|ENCODE)\b", "medium"),
    ("redshift_listagg", "redshift", "bigquery", r"\bLISTAGG\b", "medium"),
    ("bigquery_struct", "bigquery", "snowflake", r"\b(STRUCT|ARRAY)\s*<|\bUNNEST\b", "high"),
    ("snowflake_variant", "snowflake", "bigquery", r"\b(VARIANT|FLATTEN|OBJECT_INSERT)\b", "high"),
    ("vertica_to_bigquery_types", "vertica", "bigquery", r"\b(CAST|::|NUMERIC|FLOAT)\b", "medium"),
)

#: What names tables, and so no columns; qualified column references; single names in calls.
TABLE_NAMES = r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE|VIEW|PROCEDURE|FUNCTION|USING)\s+[\w.]+"
QUALIFIED = r"\b(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*\.[A-Za-z_]\w*)"
UNQUALIFIED = r"\(\s*([A-Za-z_]\w*)\s*[,)]"


#: A CREATE TABLE statement's name and columns, and one column's name and type.
DDL = r"CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+([\w.]+)\s*\(((?:[^()]|\([^()]*\))*)\)"
DDL_COLUMN = r"(?:^|,)\s*([A-Z_]\w*)\s+([A-Z]\w*(?:\([0-9, ]*\))?)"

#: Words that begin a constraint of a table, not a column.
CONSTRAINTS = ("CHECK", "CONSTRAINT", "EXCLUDE", "FOREIGN", "INDEX", "KEY", "LIKE", "PRIMARY", "UNIQUE")


def has(text: Column, *any_of: str) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in any_of))


def first_of(rules: Iterable[tuple[Column, str | int]], otherwise: str | int) -> Column:
    """The value of the first rule that holds."""
    return F.coalesce(*(F.when(condition, F.lit(value)) for condition, value in rules), F.lit(otherwise))


def object_type(path: Column, sql: Column) -> Column:
    """Class of an object, by TYPES and FILE_TYPES; a table whose text has TEMP is a temp_table."""
    up, low = F.upper(sql), F.lower(path)
    rules = [(has(up, *words), kind) for kind, words in TYPES]
    for end, plain, lower, kind in FILE_TYPES:
        held = [sql.contains(plain)] * (plain is not None) + [F.lower(sql).contains(lower)] * (lower is not None)
        rules.append((low.rlike(end) & reduce(lambda a, b: a | b, held or [F.lit(True)]), kind))
    kind = first_of(rules, "unknown")
    return F.when((kind == "table") & has(up, "TEMP"), "temp_table").otherwise(kind)


def object_name(path: Column, sql: Column) -> Column:
    """Upper-case name after the first CREATE, or the file's stem."""
    named = (F.nullif(F.regexp_extract(sql, p, 1), F.lit("")) for p in NAMES)
    return F.upper(F.coalesce(*named, F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)))


def measures(sql: Column) -> dict[str, Column]:
    """Counts of SQL constructs by pattern, with lines and statements."""
    found = {name: F.regexp_count(sql, F.lit(p)).cast("long") for name, p in MEASURES}
    count = lambda c: (F.length(sql) - F.length(F.replace(sql, F.lit(c), F.lit(""))) + 1).cast("long")
    return found | {"lines": count("\n"), "statements": count(";")}


def features(sql: Column, dialect: str) -> Column:
    """array of the dialect's features in the text, in order."""
    up = F.upper(sql)
    return F.array_compact(F.array(*(F.when(up.rlike(p), F.lit(name)) for name, p in FEATURES[dialect])))


def over(value: Column, table: tuple) -> Column:
    return first_of(((value > least, points) for least, points in table), 0)


def risk_score(m: dict[str, Column], n_features: Column, kind: Column, dependencies: Column, downstream: Column) -> Column:
    """Points of the measures, the features, the type and the neighbours in the lineage, 100 at most."""
    parts = [F.when(m[name] >= least, points).otherwise(0) for name, least, points in POINTS]
    parts += [over(m["lines"], LINE_POINTS), over(dependencies, DEPENDENCY_POINTS), over(downstream, DOWNSTREAM_POINTS)]
    parts += [F.least(n_features * 5, F.lit(25)), first_of(((kind == k, points) for k, points in TYPE_POINTS.items()), 5), F.when(m["case_expressions"] > 5, 8).otherwise(0)]
    return F.least(F.lit(100), reduce(lambda a, b: a + b, parts)).cast("long")


def by_score(score: Column, table: tuple) -> list[tuple[Column, str]]:
    return [(score >= least, value) for least, value in table]


def risk_level(score: Column) -> Column:
    return first_of(by_score(score, LEVELS), "low")


def category(score: Column, kind: Column, reviews: Column) -> Column:
    *sure, (least, reviewed) = CATEGORIES
    rules = [((kind == "temp_table") & (score < RETIRED_BELOW), "retire"), *by_score(score, sure), ((score >= least) | (reviews > 0), reviewed)]
    return first_of(rules, "auto_migrate")


def action(score: Column, category: Column, reviews: Column) -> Column:
    *sure, (least, reviewed) = ACTIONS
    return first_of([*by_score(score, sure), (category == "retire", "retire"), ((score >= least) | (reviews > REVIEWS), reviewed)], "migrate")


def assess(objects: DataFrame, dialect: str = "vertica", edges: DataFrame | None = None) -> DataFrame:
    """objects (path, source_sql) with type, name, measures, features, score, level, category and action.

    edges: a lineage (src, dst), by default that of the objects themselves; an object's dependencies are the nodes with
    an edge to it, its downstream those that it has an edge to.
    """
    sql, path = F.col("source_sql"), F.col("path")
    df = objects.withColumns({"object_type": object_type(path, sql), "name": object_name(path, sql), "features": features(sql, dialect), **measures(sql)})
    pairs = (lineage_edges(objects) if edges is None else edges).select("src", "dst").distinct()
    into = pairs.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("dependencies"))
    out = pairs.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("downstream"))
    df = df.join(into, "name", "left").join(out, "name", "left").fillna(0, ["dependencies", "downstream"])
    m = {name: F.col(name) for name in measures(sql)}
    df = df.withColumn("score", risk_score(m, F.size("features"), F.col("object_type"), F.col("dependencies"), F.col("downstream")))
    df = df.withColumn("level", risk_level(F.col("score"))).withColumn("category", category(F.col("score"), F.col("object_type"), F.lit(0)))
    return df.withColumn("action", action(F.col("score"), F.col("category"), F.lit(0)))


def behaviors(objects: DataFrame, source: str, target: str) -> DataFrame:
    """name, behavior, severity: the differences between two platforms that an object's text shows, by BEHAVIORS."""
    rules = [(name, pattern, severity) for name, a, b, pattern, severity in BEHAVIORS if (a, b) == (source, target)]
    found = F.array(*(F.when(F.col("source_sql").rlike(f"(?i){p}"), F.struct(F.lit(n).alias("behavior"), F.lit(s).alias("severity"))) for n, p, s in rules))
    named = objects.select(object_name(F.col("path"), F.col("source_sql")).alias("name"), F.explode(F.array_compact(found)).alias("found"))
    return named.select("name", "found.behavior", "found.severity")


def column_references(sql: Column) -> Column:
    """Upper-case TABLE.COLUMN of the columns a text names, distinct and sorted; single names in calls belong to _UNQUALIFIED."""
    plain = F.regexp_replace(sql, TABLE_NAMES, " ")
    single = F.transform(F.regexp_extract_all(plain, F.lit(UNQUALIFIED), F.lit(1)), lambda c: F.concat(F.lit("_UNQUALIFIED."), c))
    return F.array_sort(F.array_distinct(F.transform(F.concat(F.regexp_extract_all(plain, F.lit(QUALIFIED), F.lit(1)), single), F.upper)))


def transform_parts(up: Column) -> dict[str, Column]:
    """By kind of transform, the parts of an upper-case text that a transformed column stands in, joined by MARK.

    A pattern with {c} in its middle would be tried anew from each place of the text and for each column, and go on to the
    next bracket or the end each time. Every part is as long as a match can be, so what stands in a match stands in a part.
    """
    return {name: F.concat(F.lit(MARK), F.array_join(F.regexp_extract_all(up, F.lit(p), F.lit(1)), MARK)) for name, (p, _) in PARTS.items()}


def transformed(parts: dict[str, Column], column: Column) -> dict[str, Column]:
    """By kind of transform, whether a column, a name of letters, digits and underscores in upper case, is in a part."""
    return {name: parts[name].contains(F.concat(F.lit(MARK), column) if begins else column) for name, (_, begins) in PARTS.items()}


def transform_bits(parts: dict[str, Column], column: Column) -> Column:
    """The transforms of a column as a sum of powers of two."""
    held = (F.when(holds, 1 << k).otherwise(0) for k, holds in enumerate(transformed(parts, column).values()))
    return reduce(lambda a, b: a + b, held)


def transform_names(bits: Column) -> Column:
    """array of the transforms in a sum of powers of two, in the order of PARTS."""
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(PARTS))))


def column_bits(objects: DataFrame, *carried: str) -> DataFrame:
    """carried, name, source_column, column, bits: one row for each column that an object names.

    What an object's text must be searched for is found before there are rows of columns. Of explode Spark would infer
    that the array isn't empty, and search the texts for that before they are dealt to all tasks; not of explode_outer.
    """
    sql = F.col("source_sql")
    found = objects.select(*carried, object_name(F.col("path"), sql).alias("name"), column_references(sql).alias("_columns"), F.struct(*(c.alias(k) for k, c in transform_parts(F.upper(sql)).items())).alias("_parts"))
    rows = found.select(*carried, "name", "_parts", F.explode_outer("_columns").alias("source_column")).where("source_column IS NOT NULL")
    rows = rows.withColumn("column", F.substring_index("source_column", ".", -1))
    return rows.select(*carried, "name", "source_column", "column", transform_bits({k: F.col(f"_parts.{k}") for k in PARTS}, F.col("column")).alias("bits"))


def column_lineage(objects: DataFrame, *carried: str) -> DataFrame:
    """name, source_column, column, transforms: one row for each column that an object names, with what it does to it.

    carried: further columns of objects that the result keeps, before the others.
    """
    return column_bits(objects, *carried).select(*carried, "name", "source_column", "column", transform_names(F.col("bits")).alias("transforms"))


def _transforms(bits: Column) -> Column:
    return F.array_join(F.array_sort(transform_names(bits)), ",").alias("transforms")


def column_usage(objects: DataFrame) -> DataFrame:
    """source_column, n_objects, transforms: column_lineage merged by column over all objects."""
    once = column_bits(objects).groupBy("source_column", "name").agg(F.bit_or("bits").alias("bits"))
    return once.groupBy("source_column").agg(F.count("name").alias("n_objects"), F.bit_or("bits").alias("_bits")).select("source_column", "n_objects", _transforms(F.col("_bits")))


def table_columns(objects: DataFrame, table: str | None = None) -> DataFrame:
    """table, source_column, n_objects, transforms: the columns named by all objects that read or write a table.

    table: only this one, in any case of letters; by default every table that any object touches. An object of many
    tables and columns gives all pairs of both; they are counted where they are made, unless other objects have its name.
    """
    sql = F.col("source_sql")
    touched = objects.select("path", "source_sql", F.array_union(read_tables(sql), write_targets(sql)).alias("_tables"))
    if table is not None:
        touched = touched.where(F.array_contains("_tables", table.upper())).withColumn("_tables", F.array(F.lit(table.upper())))
    names = objects.select(object_name(F.col("path"), sql).alias("name"))
    shared = cut(names.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name", F.lit(True).alias("_shared")))
    rows = column_bits(touched, "_tables").join(shared, "name", "left")
    rows = rows.select(F.explode_outer("_tables").alias("table"), "source_column", F.when(F.col("_shared"), F.col("name")).alias("_name"), F.col("name").isNotNull().alias("_named"), "bits")
    once = rows.where("table IS NOT NULL").groupBy("table", "source_column", "_name").agg(F.count_if("_named").alias("_n"), F.bit_or("bits").alias("bits"))
    n = F.sum(F.when(F.col("_name").isNull(), F.col("_n")).otherwise(1))
    return once.groupBy("table", "source_column").agg(n.alias("n_objects"), F.bit_or("bits").alias("_bits")).select("table", "source_column", "n_objects", _transforms(F.col("_bits")))


def scope_reduction(assessed: DataFrame) -> DataFrame:
    """objects, retired, percent: how many objects need no migration, as a whole percentage of all; 0 without objects."""
    retired = F.count_if((F.col("action") == "retire") | (F.col("category") == "retire"))
    counted = assessed.agg(F.count("*").alias("objects"), retired.alias("retired"))
    return counted.withColumn("percent", F.bround(100 * F.col("retired") / F.greatest("objects", F.lit(1)), 0))


def rationalization(assessed: DataFrame) -> DataFrame:
    """action, n, share: how many objects are migrated, reviewed, rewritten or retired, and their share."""
    kind = F.when((F.col("action") == "retire") | (F.col("category") == "retire"), "retire").when(F.col("action").isin("manual_redesign", "rewrite"), "rewrite").when(F.col("action") == "review_and_migrate", "review").otherwise("migrate")
    total = assessed.agg(F.count("*").alias("_total"))
    counted = assessed.groupBy(kind.alias("action")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("action", "n", F.round(F.col("n") / F.col("_total"), 4).alias("share"))  # one row


def dashboard(assessed: DataFrame) -> DataFrame:
    """One row of totals over the assessed objects."""
    count = lambda *kinds: F.count_if(F.col("category").isin(*kinds))
    return assessed.agg(
        F.count("*").alias("total_objects"),
        count("auto_migrate").alias("auto_migratable"),
        count("auto_with_review").alias("requires_review"),
        count("manual_redesign", "partial").alias("requires_redesign"),
        count("retire").alias("recommended_retirement"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("migration_risk_score"),
    )


def write_targets(sql: Column) -> Column:
    """Upper-case names of the tables that a text writes, distinct and sorted."""
    found = F.concat(*(F.regexp_extract_all(sql, F.lit(p), F.lit(1)) for p in WRITES))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def read_tables(sql: Column) -> Column:
    """Upper-case names after FROM and JOIN, without names of common table expressions, distinct and sorted."""
    upper = lambda p: F.transform(F.regexp_extract_all(sql, F.lit(p), F.lit(1)), F.upper)
    return F.array_sort(F.array_distinct(F.array_except(upper(READS), upper(CTE_NAMES))))


def lineage_edges(objects: DataFrame) -> DataFrame:
    """src, dst, relation: table to object for reads, object to table for writes, never a loop."""
    named = objects.select(object_name(F.col("path"), F.col("source_sql")).alias("name"), "source_sql")
    reads = named.select(F.explode_outer(read_tables(F.col("source_sql"))).alias("src"), F.col("name").alias("dst"), F.lit("reads").alias("relation"))
    writes = named.select(F.col("name").alias("src"), F.explode_outer(write_targets(F.col("source_sql"))).alias("dst"), F.lit("writes").alias("relation"))
    return reads.union(writes).where("src <> dst").distinct()


def column_transforms(sql: Column, column: str) -> Column:
    """array of what a text does to a column, a name of letters, digits and underscores."""
    held = transformed(transform_parts(F.upper(sql)), F.lit(column.upper()))
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in held.items())))


def ddl_columns(objects: DataFrame) -> DataFrame:
    """table, position, column, type: what all CREATE TABLE statements of the texts declare, in upper case, without constraints."""
    groups = lambda text, p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("b"))
    statements = objects.select(F.explode(groups(F.upper("source_sql"), DDL)).alias("_s"))
    columns = F.filter(groups(F.col("_s.b"), DDL_COLUMN), lambda c: ~c["a"].isin(*CONSTRAINTS))
    rows = statements.select(F.col("_s.a").alias("table"), F.posexplode(columns).alias("_at", "_x"))
    return rows.select("table", F.col("_at").alias("position"), F.col("_x.a").alias("column"), F.col("_x.b").alias("type"))


def business_rules(sql: Column, blocks: int = 10) -> Column:
    """array of 'condition -> result' from the text's first CASE blocks, so many as blocks says."""
    cases = F.slice(F.regexp_extract_all(sql, F.lit(r"(?is)CASE\s+(.*?)\s+END"), F.lit(1)), 1, blocks)
    whens = r"(?i)WHEN\s+(.+?)\s+THEN\s+('[^']*'|\w+)"
    pairs = F.flatten(F.transform(cases, lambda c: F.arrays_zip(F.regexp_extract_all(c, F.lit(whens), F.lit(1)).alias("w"), F.regexp_extract_all(c, F.lit(whens), F.lit(2)).alias("t"))))
    return F.transform(pairs, lambda p: F.concat(F.trim(p["w"]), F.lit(" -> "), p["t"]))


def load_pattern(sql: Column) -> Column:
    """How a script loads its table, by the rows of LOADS."""
    up = F.upper(sql)
    holds = lambda every, some: reduce(lambda a, b: a & b, [*(up.contains(x) for x in every), *([has(up, *some)] if some else [])])
    return first_of([(holds(every, some), name) for name, every, some in LOADS], "Full refresh")


def load_strategy(pattern: Column) -> Column:
    return F.when(pattern == "Delete and reload", "delete+insert").when(pattern == "Full refresh", "N/A").otherwise("merge")
