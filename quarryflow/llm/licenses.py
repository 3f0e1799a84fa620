"""Licence scan by sentence rules (operator 2).

A text falls into sentences at line ends, after ., ! and ? (but for "v."), and after "conditions:" and
");" within a line. Lines without a blank line or such a mark between them
are joined where that shows a pattern that neither holds alone, so hard-wrapped and commented notices are read whole,
and lines that each hold a pattern stay apart. Each sentence is normalised (ASCII lower case, "licence"
as "license", everything else than letters and digits one blank) and mapped to the identifier of the first sentence
pattern that it holds. The identifiers, in text order, are matched against ordered licence rules: each rule is a
sequence of identifiers; where it stands it counts one finding of its licence and takes the identifiers away, so that
the rules after it see only what is left. Sentences without an identifier do not interrupt a sequence. An SPDX line is
one rule for all licences: each name of its expression, with the exception after WITH, counts one finding, spelt as it
stands there; a line without a readable expression stays unmatched.

Only built-in functions run; texts without any cue word are passed over by one regular expression.

Defined cases: null and empty texts have no sentences and no licences; repeated rows, null doc_ids and empty tables
pass through; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cues of the comparison SQL, which takes each line by itself.
CUES = r"(?i)licen[cs]e|copyright|warrant|redistribut|permission|free software|public domain|liab|rights reserved|received a copy|published by"

#: Single words of which every text with a sentence pattern holds one, however its lines are wrapped.
WORDS = r"(?i)licen[cs]e|copyright|warrant|redistribut|permission|domain|liable|reserved|received|cc0|commons|mpl|hope|endorse"

#: Sentence identifiers and their patterns over normalised sentences, in order.
SENTENCES = (
    ("spdx", r"spdx license identifier\b"),
    ("cc_by_nc_4", r"licensed under (?:the |a )?(?:cc by nc|creative commons attribution non ?commercial) 4 0"),
    ("cc_by_sa_4", r"licensed under (?:the |a )?(?:cc by sa|creative commons attribution share ?alike) 4 0"),
    ("cc_by_4", r"licensed under (?:the |a )?(?:cc by|creative commons attribution) 4 0"),
    ("cc0", r"(?:cc0 1 0|creative commons zero)"),
    ("apache2_under", r"licensed under the apache license version 2 0"),
    ("apache2_comply", r"you may not use this file except in compliance with the license"),
    ("apache2_copy", r"you may obtain a copy of the license at"),
    ("apache2_basis", r"software distributed under the license is distributed on an as is basis"),
    ("apache2_see", r"see the license for the specific language governing permissions"),
    ("agpl3_under", r"gnu affero general public license.* version 3"),
    ("lgpl21_later", r"gnu lesser general public license.*version 2 1.*or (?:at your option )?any later version"),
    ("lgpl3_later", r"gnu lesser general public license.*version 3.*or (?:at your option )?any later version"),
    ("lgpl21_under", r"gnu lesser general public license.* version 2 1"),
    ("lgpl3_under", r"gnu lesser general public license.* version 3"),
    ("gpl3_later", r"gnu general public license.*version 3.*or (?:at your option )?any later version"),
    ("gpl2_later", r"gnu general public license.*version 2.*or (?:at your option )?any later version"),
    ("gpl3_under", r"gnu general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("gpl2_under", r"gnu general public license(?: as published by the free software foundation)?(?: either)? version 2"),
    ("gpl_hope", r"distributed in the hope that it will be useful"),
    ("gpl_received", r"you should have received a copy of the gnu"),
    ("mpl2_under", r"subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("mpl2_obtain", r"if a copy of the mpl was not distributed with this file"),
    ("mit_under", r"(?:released|licensed|distributed|available) under the mit license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit_notice", r"the above copyright notice and this permission notice .*shall be included in all copies"),
    ("as_is", r"the software is provided as is without warranty of any kind"),
    ("no_liability", r"in no event shall the (?:authors|copyright holders?|regents).* be liable"),
    ("bsd_permit", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_name", r"neither the name of .* may be used to endorse or promote products"),
    ("bsd_as_is", r"this software is provided by .* as is and any express or implied warranties"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("zlib_as_is", r"this software is provided as is without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("epl2_under", r"eclipse public license v(?:ersion)? ?2 0"),
    ("epl1_under", r"eclipse public license v(?:ersion)? ?1 0"),
    ("cddl1_under", r"common development and distribution license(?: version)? 1 0"),
    ("artistic2_under", r"artistic license(?: version)? 2 0"),
    ("bsl1_under", r"boost software license version 1 0"),
    ("eupl12_under", r"european union public license v(?:ersion)? ?1 2"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("public_domain", r"(?:placed in|released into|dedicated to) the public domain"),
    ("all_rights", r"all rights reserved"),
    ("copyright_line", r"^copyright (?:c )?[0-9]{4}"),
)

#: Licences and the sequences of sentence identifiers that show them, in the order of matching.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is", "no_liability")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("BSD-3-Clause", ("bsd_permit", "bsd_source", "bsd_binary", "bsd_name", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_permit", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_permit", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_permit", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2_under", "apache2_comply", "apache2_copy", "apache2_basis", "apache2_see")),
    ("Apache-2.0", ("apache2_under", "apache2_comply", "apache2_copy")),
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_hope", "gpl_received")),
    ("GPL-2.0-or-later", ("gpl2_later", "gpl_hope", "gpl_received")),
    ("AGPL-3.0", ("agpl3_under", "gpl_hope", "gpl_received")),
    ("MPL-2.0", ("mpl2_under", "mpl2_obtain")),
    ("ISC", ("isc_grant", "as_is")),
    ("MIT", ("mit_under",)),
    ("Apache-2.0", ("apache2_under",)),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("GPL-3.0", ("gpl3_under",)),
    ("GPL-2.0", ("gpl2_under",)),
    ("AGPL-3.0", ("agpl3_under",)),
    ("LGPL-2.1-or-later", ("lgpl21_later", "gpl_hope", "gpl_received")),
    ("LGPL-3.0-or-later", ("lgpl3_later", "gpl_hope", "gpl_received")),
    ("LGPL-2.1-or-later", ("lgpl21_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_later",)),
    ("LGPL-2.1", ("lgpl21_under",)),
    ("LGPL-3.0", ("lgpl3_under",)),
    ("MPL-2.0", ("mpl2_under",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC0-1.0", ("cc0",)),
    ("ISC", ("isc_grant",)),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("EPL-2.0", ("epl2_under",)),
    ("EPL-1.0", ("epl1_under",)),
    ("CDDL-1.0", ("cddl1_under",)),
    ("Artistic-2.0", ("artistic2_under",)),
    ("BSL-1.0", ("bsl1_under",)),
    ("EUPL-1.2", ("eupl12_under",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public_domain",)),
    ("All-Rights-Reserved", ("copyright_line", "all_rights")),
    ("All-Rights-Reserved", ("all_rights",)),
)

#: An SPDX line and the expression it states; a licence of an expression, with its exception.
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?"
_TERM = rf"(?:\([ \t]*)*{_ID}(?:[ \t]*\))*"
SPDX = rf"(?i:spdx-licen[cs]e-identifier)[ \t]*[:=][ \t]*[\"']?({_TERM}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_TERM})*)"
SPDX_NAME = rf"{_ID}(?:[ \t]+WITH[ \t]+{_ID})?"

BREAK = r"(?<! [vV])([.!?])[ \t\n\x0B\f\r]+"
#: Where the sentences of a notice that stands in one line part without a full stop.
CLAUSE = r"(?i)(conditions(?: are met)?:|\);)[ \t\x0B\f\r]+"


_LINES = "array<struct<text:string,plain:string>>"


def normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(F.lower(sentence), "licence", "license")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, or null."""
    return reduce(lambda rest, rule: F.when(sentence.rlike(rule[1]), F.lit(rule[0])).otherwise(rest), reversed(SENTENCES), F.lit(None).cast("string"))


def sequence(names: tuple[str, ...]) -> str:
    return "".join(f"<{name}>" for name in names)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, sentences (structs of identifier and text, in order), licences (license, n)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(F.regexp_replace(F.regexp_replace(text, BREAK, "$1\n\n"), CLAUSE, "$1\n\n"), "\n")
    plain = F.transform(lines, lambda s: F.struct(s.alias("text"), normalised(s).alias("plain")))
    df = docs.select("doc_id", F.when(text.rlike(WORDS), plain).otherwise(F.array().cast(_LINES)).alias("_lines"))
    known = lambda plain: F.when(plain.rlike(WORDS), identifier(plain))
    df = df.select("doc_id", F.transform("_lines", lambda s: F.struct(s["text"].alias("text"), s["plain"].alias("plain"), known(s["plain"]).alias("identifier"))).alias("_lines"))
    nothing = F.struct(F.lit("").alias("text"), F.lit("").alias("plain"), F.lit(None).cast("string").alias("identifier"))
    done = lambda state: F.when(state["open"]["identifier"].isNotNull(), F.concat(state["found"], F.array(F.struct(state["open"]["identifier"].alias("identifier"), state["open"]["text"].alias("text"))))).otherwise(state["found"])

    def add(state: Column, line: Column) -> Column:
        """Join the line to the open sentence, or close that and open a new one."""
        old, plain = state["open"], F.concat_ws(" ", state["open"]["plain"], line["plain"])
        both = F.struct(F.concat_ws("\n", old["text"], line["text"]).alias("text"), plain.alias("plain"), known(plain).alias("identifier"))

        def choose(joined: Column) -> Column:
            name = joined["identifier"]
            new = name.isNotNull() & ~name.eqNullSafe(line["identifier"]) & ~name.eqNullSafe(old["identifier"])
            joins = new | line["identifier"].isNull()
            closed = F.struct(done(state).alias("found"), F.struct(line["text"].alias("text"), line["plain"].alias("plain"), line["identifier"].alias("identifier")).alias("open"))
            return F.when(joins, F.struct(state["found"].alias("found"), joined.alias("open"))).otherwise(closed)

        fresh = F.struct(done(state).alias("found"), F.when(line["plain"] == "", nothing).otherwise(line).alias("open"))
        return F.when((line["plain"] == "") | (old["plain"] == ""), fresh).otherwise(F.get(F.transform(F.array(both), choose), F.lit(0)))

    start = F.struct(F.array().cast("array<struct<identifier:string,text:string>>").alias("found"), nothing.alias("open"))
    df = df.select("doc_id", F.aggregate("_lines", start, add, done).alias("sentences"))
    stated = lambda s: F.when(s["identifier"] == "spdx", F.regexp_extract(s["text"], SPDX, 1)).otherwise("")
    mark = lambda s: F.when(stated(s) != "", F.lit(".")).otherwise(F.concat(F.lit("<"), s["identifier"], F.lit(">")))
    df = df.withColumn("_left", F.array_join(F.transform("sentences", mark), ""))
    named = F.flatten(F.transform("sentences", lambda s: F.regexp_extract_all(stated(s), F.lit(SPDX_NAME), F.lit(0))))
    named = F.transform(F.filter(named, lambda x: ~x.isin("AND", "OR")), lambda x: F.struct(F.regexp_replace(x, "[ \t]+", " ").alias("license"), F.lit(1).alias("n")))
    rules = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(sequence(s)).alias("pattern")) for name, s in RULES))

    def apply(state: Column, rule: Column) -> Column:
        without = F.replace(state["left"], rule["pattern"], F.lit(""))
        n = ((F.length(state["left"]) - F.length(without)) / F.length(rule["pattern"])).cast("int")
        one = F.array(F.struct(rule["license"].alias("license"), n.alias("n")))
        found = F.when(n > 0, F.concat(state["found"], one)).otherwise(state["found"])
        return F.struct(F.replace(state["left"], rule["pattern"], F.lit(".")).alias("left"), found.alias("found"))

    start = F.struct(F.col("_left").alias("left"), named.cast("array<struct<license:string,n:int>>").alias("found"))
    matched = F.aggregate(rules, start, apply)
    df = df.withColumn("_matched", F.when(F.col("_left") != "", matched))
    return df.select("doc_id", "sentences", F.coalesce(F.col("_matched.found"), F.array().cast("array<struct<license:string,n:int>>")).alias("licenses"), F.coalesce(F.col("_matched.left"), F.lit("")).alias("unmatched"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_unmatched, sentence_ids, licenses (distinct names, sorted, comma-joined), n_licenses."""
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        (F.length("unmatched") - F.length(F.replace("unmatched", F.lit("<"), F.lit("")))).cast("long").alias("n_unmatched"),
        F.array_join(F.col("sentences.identifier"), ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",").alias("licenses"),
        F.aggregate("licenses", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_licenses"),
    )


def oracle_sql() -> str:
    """The digest in DuckDB SQL, from the same fixed values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN {quote(n)}" for n, p in SENTENCES)
    steps, cues = [], quote(CUES)
    for k, (_, s) in enumerate(RULES):
        p = quote(sequence(s))
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (l), replace(l, {p}, '.') AS l, (length(l) - length(replace(l, {p}, ''))) // length({p}) AS n{k} FROM s{k})")
    names = ", ".join(f"CASE WHEN n{k} > 0 THEN {quote(name)} END" for k, (name, _) in enumerate(RULES))
    return f"""
WITH lines AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, {cues})) AS ls FROM documents),
plain AS (SELECT doc_id, ls, list_transform(ls, lambda x: trim(regexp_replace(replace(lower(x), 'licence', 'license'), '[^a-z0-9]+', ' ', 'g'))) AS ps FROM lines),
named AS (SELECT doc_id, list_filter(list_transform(list_zip(list_transform(ps, lambda s: CASE {cases} END), list_transform(ls, lambda x: regexp_extract(x, {quote(SPDX)}, 1))), lambda x: {{'id': x[1], 'spdx': CASE WHEN x[1] = 'spdx' THEN x[2] ELSE '' END}}), lambda x: x.id IS NOT NULL) AS found FROM plain),
s0 AS (SELECT doc_id, list_transform(found, lambda x: x.id) AS ids,
  list_filter(flatten(list_transform(found, lambda x: regexp_extract_all(x.spdx, {quote(SPDX_NAME)}))), lambda x: x NOT IN ('AND', 'OR')) AS spdx,
  coalesce(array_to_string(list_transform(found, lambda x: CASE WHEN x.spdx <> '' THEN '.' ELSE '<' || x.id || '>' END), ''), '') AS l FROM named),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, CAST(length(l) - length(replace(l, '<', '')) AS BIGINT) AS n_unmatched,
  coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(coalesce(spdx, []), lambda x: regexp_replace(x, '[ \\t]+', ' ', 'g')), list_filter([{names}], lambda x: x IS NOT NULL)))), ','), '') AS licenses,
  CAST(coalesce(len(spdx), 0) + {" + ".join(f"n{k}" for k in range(len(RULES)))} AS BIGINT) AS n_licenses
FROM s{len(RULES)}"""
