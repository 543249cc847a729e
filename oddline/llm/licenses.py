"""Licence recognition by sentence rules, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddline.llm.common import columns, lower_ascii

# Sentences of public licences and notices, normalised (lower case,
# runs of other signs than letters and digits are one blank), in order of their number.
SENTENCES = [
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "released under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "licensed under cc by nc 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
]

# A licence is found where these sentence numbers follow each other,
# with any other text in between.  The longer of two rules that start alike is the more specific.
RULES = [
    ("Apache-2.0", "short notice", [0]),
    ("Apache-2.0", "notice", [1, 2, 4, 5]),
    ("MIT", "short notice", [6]),
    ("MIT", "text", [7, 8, 9, 10]),
    ("GPL-3.0-only", "short notice", [11]),
    ("GPL-3.0-or-later", "notice", [12, 13, 14]),
    ("CC-BY-NC-4.0", "short notice", [15]),
    ("CC-BY-4.0", "short notice", [16]),
    ("BSD-2-Clause", "text", [17, 18, 19]),
    ("BSD-3-Clause", "text", [17, 18, 19, 20]),
    ("ISC", "text", [21]),
]

# What the splitter makes of sentences 12 and 13 as they are printed, with
# a ':' or ';' inside.  Their numbers go on from SENTENCES; the SQL twin has not got them.
SPLIT_SENTENCES = [
    "this program is free software",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose",
]
SPLIT_RULES = [
    ("GPL-3.0-or-later", "notice", [22, 23, 24, 25, 14]),
    ("GPL-3.0-or-later", "notice", [22, 23, 13, 14]),
    ("GPL-3.0-or-later", "notice", [12, 24, 25, 14]),
]

# Where a sentence ends: at its sign and white space, or at a blank line; in the
# second reading every line end is one, too.
SENTENCE_END = r"[.!?:;]+(?:[ \t\r\n]+|$)|\n[ \t\r\n]*\n"
LINE_END = r"[.!?:;]+(?:[ \t\r\n]+|$)|\n"
HINT = "(?i)licens|permi|redistribut|software|program|warrant"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " "))


def _known(text: Column, end: str) -> Column:
    """Numbers of the licence sentences of a text, in order; the hint only saves work."""
    numbers = F.create_map(*[x for i, s in enumerate(SENTENCES + SPLIT_SENTENCES) for x in (F.lit(s), F.lit(i))])
    likely = F.filter(F.split(text, end), lambda p: p.rlike(HINT))
    return F.filter(F.transform(likely, lambda p: F.try_element_at(numbers, normalised(p))), lambda n: n.isNotNull())


def _holds(numbers: Column, rule: list[int]) -> Column:
    """Whether the rule's sentences occur in order: each is looked for after the one before it."""
    wanted = F.array(*[F.lit(n) for n in rule])
    step = F.aggregate(
        numbers, F.lit(0), lambda done, n: F.when(F.get(wanted, done) == n, done + 1).otherwise(done)
    )
    return step == len(rule)


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, sentences, lines, licenses, rules`` of every row.

    ``sentences`` holds the numbers of the known licence sentences in order, with
    line ends read as blanks; ``lines`` the same with line ends ending a sentence.
    A rule matches if its numbers occur in order in one of the two.  ``licenses``
    are the matched licences, each once, ``rules`` the matched rules.  A null or
    empty text has none; repeated rows are all returned; a text of any length is
    read whole.
    """
    text = F.coalesce("text", F.lit(""))
    read = columns(docs, "doc_id", "text").select(
        "doc_id", _known(text, SENTENCE_END).alias("sentences"), _known(text, LINE_END).alias("lines")
    )
    rules = F.array(
        *[
            F.when(_holds(F.col("sentences"), rule) | _holds(F.col("lines"), rule), f"{name} ({kind})")
            for name, kind, rule in RULES + SPLIT_RULES
        ]
    )
    matched = F.array_distinct(F.filter(rules, lambda r: r.isNotNull()))
    names = F.array_sort(F.array_distinct(F.transform("rules", lambda r: F.split_part(r, F.lit(" ("), F.lit(1)))))
    return read.withColumn("rules", matched).select("doc_id", "sentences", "lines", names.alias("licenses"), "rules")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.array_join(F.col("sentences").cast("array<string>"), ",").alias("sentence_ids"),
        F.array_join(F.col("lines").cast("array<string>"), ",").alias("line_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("rules", ",").alias("rules"),
    )


def _sql() -> str:
    sentences = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"

    def known(end: str) -> str:
        norm = (
            "trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
            " '[^a-z0-9]+', ' ', 'g'))"
        )
        parts = f"regexp_split_to_array(coalesce(text, ''), '{end}')"
        place = f"coalesce(list_position({sentences}, {norm}), 0) - 1"
        return f"array_to_string(list_filter(list_transform({parts}, lambda p: {place}), lambda n: n >= 0), ',')"

    def rule(numbers: list[int]) -> str:
        pattern = "," + r",(?:\d+,)*".join(map(str, numbers)) + ","
        return " OR ".join(f"regexp_matches(',' || {c} || ',', '{pattern}')" for c in ("sentence_ids", "line_ids"))

    cases = ", ".join(f"CASE WHEN {rule(r)} THEN '{name} ({kind})' END" for name, kind, r in RULES)
    return f"""
        WITH k AS (SELECT doc_id, {known(SENTENCE_END)} AS sentence_ids, {known(LINE_END)} AS line_ids FROM documents),
        r AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS found FROM k)
        SELECT doc_id, sentence_ids, line_ids, array_to_string(found, ',') AS rules,
               array_to_string(list_sort(list_distinct(list_transform(found, lambda x: split_part(x, ' (', 1)))), ',')
                   AS licenses
        FROM r
    """


SQL = {"op6_license_scan": _sql()}
