"""License scans by sentence rules, in DataFrame functions alone.

A text's sentences are normalised and mapped to the identifiers of known licence
sentences; rules, in a fixed order, are sequences of identifiers that must stand side by
side. No Python runs on rows and nothing is shuffled: a text becomes an array of
sentences, an array of identifiers, and a string that rules are looked up in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences as they read once normalised (lower case, letters and digits, single spaces).
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "licensed under the apache license version 2 0",
    6: "licensed under the apache license version 2 0 the license",
    7: "you may not use this file except in compliance with the license",
    8: "you may obtain a copy of the license at",
    9: "this work is licensed under the gnu general public license version 3",
    10: "this work is licensed under the gnu general public license version 2",
    11: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    13: "licensed under cc by nc 4 0",
    14: "licensed under cc by 4 0",
    15: "licensed under cc by sa 4 0",
    16: "licensed under cc by nd 4 0",
    17: "this work is licensed under a creative commons attribution 4 0 international license",
    18: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    19: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    20: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    23: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    24: "this source code form is subject to the terms of the mozilla public license v 2 0",
    25: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    26: "this is free and unencumbered software released into the public domain",
    27: "licensed under the bsd 3 clause license",
    28: "licensed under the bsd 2 clause license",
    29: "licensed under the mozilla public license version 2 0",
    30: "all rights reserved",
}
#: Ordered rules: licence, identifiers side by side. The first that matches is a text's main licence.
RULES = [
    ("MIT", (3, 4)),
    ("BSD-3-Clause", (20, 21, 22, 23)),
    ("BSD-2-Clause", (20, 21, 22)),
    ("Apache-2.0", (6, 7, 8)),
    ("GPL-3.0-or-later", (11,)),
    ("GPL-2.0-or-later", (12,)),
    ("ISC", (25,)),
    ("MPL-2.0", (24,)),
    ("MPL-2.0", (29,)),
    ("Unlicense", (26,)),
    ("Apache-2.0", (5,)),
    ("Apache-2.0", (6,)),
    ("GPL-3.0", (9,)),
    ("GPL-2.0", (10,)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("BSD-3-Clause", (27,)),
    ("BSD-2-Clause", (28,)),
    ("CC-BY-NC-4.0", (13,)),
    ("CC-BY-NC-4.0", (18,)),
    ("CC-BY-SA-4.0", (15,)),
    ("CC-BY-SA-4.0", (19,)),
    ("CC-BY-ND-4.0", (16,)),
    ("CC-BY-4.0", (14,)),
    ("CC-BY-4.0", (17,)),
    ("proprietary", (30,)),
]
#: Every known sentence has one of these in it, so a text without any needs no more work.
ANCHOR = "(?i)licen[cs]e|permission|copyright|redistribut|public domain|rights reserved"
#: Where a sentence ends: at a line break, or at an end mark before white space.
BREAK = r"[.!?]+[ \t\r\n]+|[\n]+"

#: Between two words of a known sentence: marks, and single line breaks with what stands before a comment's or list's lines; no empty line, no end of a sentence but before a digit ("v. 2.0").
_GAP = r"(?:[^A-Za-z0-9.!?\n]|\n(?![^A-Za-z0-9\n]*\n)|[.!?](?![ \t\r\n])|\.[ \t]+(?=[0-9]))++"
#: A number or letter of a list.
_LABEL = r"\(?(?:[0-9]{1,2}|[A-Za-z])[.)]+[ \t]+"
#: A known sentence as it stands in texts: from the start of a sentence, or right after another known one, with or without a list label, up to an end, which here is a semicolon too, or a colon before a list.
WRAPPED = (
    rf"(?i)(?:\G(?!\A)|(?<=\A|\n|[.!?][ \t\r\n]))[^A-Za-z0-9]*+(?:{_LABEL})?+[^A-Za-z0-9]*+("
    + "|".join(s.replace(" ", _GAP) for s in sorted(SENTENCES.values(), key=len, reverse=True))
    + rf")(?![A-Za-z0-9])(?=[^A-Za-z0-9]*?(?:[.!?]+[ \t\r\n]|[\n;]|\z|:[ \t]+{_LABEL}))"
)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's sentences in order, 0 for unknown ones; sentences without a letter or digit are none.

    Known sentences are found first, over line breaks as well; what is between them is
    cut at BREAK.
    """
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    number = lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0))
    between = F.transform(F.split(text, WRAPPED), lambda p: F.transform(F.filter(F.transform(F.split(p, BREAK), _plain), lambda s: s != ""), number))
    found = F.transform(F.regexp_extract_all(text, F.lit(WRAPPED), F.lit(1)), lambda s: F.array(number(_plain(s))))
    none = F.array().cast("array<int>")
    return F.flatten(F.zip_with(between, found, lambda a, b: F.concat(F.coalesce(a, none), F.coalesce(b, none))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_known, sentence_ids, main_license, licenses): one row a document.

    n_known: known sentences; sentence_ids: their identifiers joined by commas, a 0 for
    each unknown sentence, empty if none is known; licenses: all that a rule finds, in
    the order of the rules, each once, joined by commas; main_license: the first, null
    if there is none. Null texts count as empty; repeated rows get equal results; empty
    input none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = F.when(text.rlike(ANCHOR), sentence_ids(text)).otherwise(F.array().cast("array<int>"))
    found = docs.select(F.col(id_col), ids.alias("__ids"))
    n_known = F.size(F.filter("__ids", lambda i: i > 0))
    joined = F.when(n_known > 0, F.array_join(F.transform("__ids", lambda i: i.cast("string")), ",")).otherwise("")
    found = found.select(id_col, n_known.cast("long").alias("n_known"), joined.alias("sentence_ids"))
    inside = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    hits = [F.when(F.contains(inside, F.lit("," + ",".join(map(str, ids)) + ",")), F.lit(name)) for name, ids in RULES]
    named = F.when(F.col("n_known") > 0, F.array_distinct(F.array_compact(F.array(*hits)))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("__named", named)
    return found.select(id_col, "n_known", "sentence_ids", F.get("__named", F.lit(0)).alias("main_license"), F.array_join("__named", ",").alias("licenses"))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for scan() of a table, but for known sentences that go over line breaks, follow a list label or end at a semicolon: it leaves those out."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {i})" for i, s in SENTENCES.items())
    rules = ", ".join(f"({k}, {quote(n)}, {quote(',' + ','.join(map(str, ids)) + ',')})" for k, (n, ids) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
rules(pos, name, ids) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {table}),
parts AS (
  SELECT r, unnest(regexp_split_to_array(text, '{BREAK}')) AS s, generate_subscripts(regexp_split_to_array(text, '{BREAK}'), 1) AS pos
  FROM docs WHERE regexp_matches(text, '{ANCHOR}')),
plain AS (SELECT r, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts),
ids AS (
  SELECT r, count(id) AS n_known, string_agg(coalesce(id, 0)::VARCHAR, ',' ORDER BY pos) AS joined
  FROM plain LEFT JOIN known ON known.sentence = plain.s WHERE s <> '' GROUP BY r),
full_ids AS (
  SELECT docs.r, doc_id, coalesce(n_known, 0) AS n_known, CASE WHEN n_known > 0 THEN joined ELSE '' END AS sentence_ids
  FROM docs LEFT JOIN ids ON docs.r = ids.r),
hits AS (
  SELECT r, name, min(pos) AS pos FROM full_ids JOIN rules ON contains(',' || sentence_ids || ',', rules.ids)
  WHERE n_known > 0 GROUP BY r, name),
named AS (SELECT r, string_agg(name, ',' ORDER BY pos) AS licenses, arg_min(name, pos) AS main_license FROM hits GROUP BY r)
SELECT doc_id, n_known::BIGINT AS n_known, sentence_ids, main_license, coalesce(licenses, '') AS licenses
FROM full_ids LEFT JOIN named ON full_ids.r = named.r"""
