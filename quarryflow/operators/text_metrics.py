"""Comparison of SQL texts: normal form, tokens, exact match, token F1, bigram Dice, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as a token.
TOKEN = r"[a-z_][a-z0-9_]*|\d+|[=<>!()*,.]"
#: A pair passes when exact, or at these least F1 and Dice.
LEAST_F1, LEAST_DICE = 0.85, 0.75


def normal_form(text: Column) -> Column:
    """Lower case, no comments, single blanks, no semicolons."""
    out = F.regexp_replace(F.lower(text), r"(?m)--.*?$", "")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " ")
    return F.trim(F.replace(out, F.lit(";"), F.lit("")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(normal_form(text), F.lit(TOKEN), F.lit(0))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a text of one character is its own.

    The text is taken apart once. Inside the transform its characters have a name; an expression would be worked out
    anew for every pair.
    """
    def pairs(letters: Column) -> Column:
        n = F.size(letters) - 1
        return F.array_distinct(F.zip_with(F.slice(letters, F.lit(1), n), F.slice(letters, F.lit(2), n), lambda x, y: F.concat(x, y)))

    return F.when(F.length(text) < 2, F.array(text)).otherwise(F.get(F.transform(F.array(F.split(text, "")), pairs), F.lit(0)))


def dice(a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    """of_a, of_b: the bigrams of both texts."""
    value = 2.0 * F.size(F.array_intersect(of_a, of_b)) / F.greatest(F.size(of_a) + F.size(of_b), F.lit(1))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(value)


def token_f1(pairs: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """key and token_f1: overlap of the two texts' token multisets. Counts are joined by (key, token)."""
    def counts(text: str, name: str) -> DataFrame:
        return pairs.select(key, F.explode(tokens(F.col(text))).alias("t")).groupBy(key, "t").agg(F.count("*").alias(name))

    shared = counts(predicted, "p").join(counts(gold, "g"), [key, "t"]).groupBy(key).agg(F.sum(F.least("p", "g")).alias("both"))
    sizes = pairs.select(key, F.size(tokens(F.col(predicted))).alias("np"), F.size(tokens(F.col(gold))).alias("ng"))
    f1 = F.when((F.col("np") == 0) & (F.col("ng") == 0), 1.0).otherwise(F.coalesce(2.0 * F.col("both") / (F.col("np") + F.col("ng")), F.lit(0.0)))
    return sizes.join(shared, key, "left").select(key, f1.alias("token_f1"))


def evaluate(pairs: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """key, exact_match, token_f1, fuzzy, passed for each pair of texts."""
    a, b, of_a, of_b = (F.col(f"_{c}") for c in ("a", "b", "of_a", "of_b"))
    plain = pairs.select(key, normal_form(F.col(predicted)).alias("_a"), normal_form(F.col(gold)).alias("_b"))
    plain = plain.withColumns({"_of_a": bigrams(a), "_of_b": bigrams(b)})
    scored = plain.select(key, (a == b).cast("double").alias("exact_match"), dice(a, b, of_a, of_b).alias("fuzzy")).join(token_f1(pairs, key, predicted, gold), key)
    passed = (F.col("exact_match") == 1) | ((F.col("token_f1") >= LEAST_F1) & (F.col("fuzzy") >= LEAST_DICE))
    return scored.select(key, "exact_match", "token_f1", "fuzzy", passed.alias("passed"))


def summary(evaluated: DataFrame, by: str) -> DataFrame:
    """Means by category and, in a row with a null category, over all."""
    means = [F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("exact_match", "token_f1", "fuzzy", "passed")]
    return evaluated.rollup(by).agg(F.count("*").alias("n_pairs"), *means)
