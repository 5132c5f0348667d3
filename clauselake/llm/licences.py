"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences (line breaks, and stops that white space follows; a line that ends in a comma or goes on in small
letters is joined with the next). A sentence is normalised to its lower-case words and digits and mapped to the identifier of a
known licence sentence. A rule is an ordered sequence of identifiers: it matches where they follow one another with at
most ``GAP`` other sentences between two of them. A new first sentence starts the rule anew. Matches that lie within a
match of a longer rule are left out.

Nothing is shuffled: everything about a document happens in its row, and only texts with one of the words that every
known sentence has are cut at all. Inside the words of a known sentence nothing is cut: a line may be wrapped at any
word, whatever the next one begins with, and stops that the licence itself has there (``OPEN``) do not count.

Cases: null or blank texts have no matches; a null doc_id is kept; repeated rows are scanned each for itself; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sentences that may stand between two sentences of a rule
GAP = 2
#: fixed values: known licence sentences, normalised
SENTENCES = {
    "apache-2-under": "licensed under the apache license version 2 0",
    "apache-2-under-the-license": "licensed under the apache license version 2 0 the license",
    "apache-2-project": "this project is licensed under the apache license 2 0",
    "apache-2-compliance": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-language": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "mit-name": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-3-under": "licensed under the bsd 3 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3-under": "licensed under the gnu general public license version 3",
    "gpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "mpl-2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-copy": "if a copy of the license was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by-4-under": "licensed under cc by 4 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-under": "licensed under cc by sa 4 0",
    "cc-by-nc-4-under": "licensed under cc by nc 4 0",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
#: fixed values: rules as licence, rule, and the identifiers in their order
RULES = [
    ("Apache-2.0", "reference", ["apache-2-under"]),
    ("Apache-2.0", "reference-the-license", ["apache-2-under-the-license"]),
    ("Apache-2.0", "project", ["apache-2-project"]),
    ("Apache-2.0", "notice", ["apache-2-under", "apache-2-compliance", "apache-2-copy", "apache-2-basis", "apache-2-language"]),
    ("Apache-2.0", "notice-the-license", ["apache-2-under-the-license", "apache-2-compliance", "apache-2-copy", "apache-2-basis", "apache-2-language"]),
    ("MIT", "released", ["mit-released"]),
    ("MIT", "licensed", ["mit-licensed"]),
    ("MIT", "project", ["mit-project"]),
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", "titled-text", ["mit-name", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("BSD-2-Clause", "text", ["bsd-conditions", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", "text", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", "reference", ["bsd-3-under"]),
    ("ISC", "text", ["isc-grant"]),
    ("GPL-3.0", "work", ["gpl-3-work"]),
    ("GPL-3.0", "reference", ["gpl-3-under"]),
    ("GPL-3.0-or-later", "notice", ["gpl-3-free", "gpl-hope", "gpl-details", "gpl-copy"]),
    ("MPL-2.0", "notice", ["mpl-2-subject"]),
    ("MPL-2.0", "notice-with-copy", ["mpl-2-subject", "mpl-2-copy"]),
    ("CC-BY-4.0", "reference", ["cc-by-4-under"]),
    ("CC-BY-4.0", "work", ["cc-by-4-work"]),
    ("CC-BY-SA-4.0", "reference", ["cc-by-sa-4-under"]),
    ("CC-BY-NC-4.0", "reference", ["cc-by-nc-4-under"]),
    ("CC-BY-NC-4.0", "work", ["cc-by-nc-4-work"]),
]
#: fixed values: further wordings of known sentences, as the licences' own texts have them
WORDINGS = {
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-2-copy",
}
#: fixed values: places inside known sentences where the licences' own texts have a stop
OPEN = {("software", "you"), ("warranty", "without"), ("v", "2")}
#: every known sentence has one of these
ANCHORS = ["licens", "copyright", "permission", "redistribution", "warrant", "liability"]
JOINED = r"([^.!?:; \t\r\n])[ \t\r]*\n[ \t\r\n]*(?:[*#/;-]+[ \t]*)?([a-z])"
COMMA = r",[ \t\r]*\n"
STOP = r"([.!?;:])[ \t\r\n]+"


def _unbroken(sentence: str) -> tuple[str, str, str]:
    """A word that the sentence needs, the pattern of the sentence wrapped anywhere, and what takes its place."""
    words, address = sentence.split(), False
    pattern = rf"(?i)\b({words[0]})"
    for before, after in zip(words, words[1:], strict=False):
        if address or after == "0":
            between = r"[^a-z0-9\s]+"
        elif after.startswith("http"):
            between, address = "[^a-z0-9.!?;:]+", True
        elif (before, after) in OPEN:
            between = "[^a-z0-9]+"
        else:  # no stop, and no empty line
            between = r"(?:[^a-z0-9.!?;:\n]+(?:\n[^a-z0-9.!?;:\n]*)?|\n[^a-z0-9.!?;:\n]*)"
        pattern += between + after
    return max(words, key=len), pattern + r"(?=[^a-z0-9.!?;:\n]*(?:[.!?;:\n]|\z))", " ".join(["$1", *words[1:]])


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order."""
    unbroken = [_unbroken(s) for s in sorted([*SENTENCES.values(), *WORDINGS], key=len, reverse=True)]
    known = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).alias("pattern"), F.lit(r).alias("whole")) for w, p, r in unbroken])

    def mend(s: Column, k: Column) -> Column:
        mended = F.when(F.contains(s["low"], k["word"]), F.regexp_replace(s["text"], k["pattern"], k["whole"])).otherwise(s["text"])
        return F.struct(mended.alias("text"), s["low"].alias("low"))

    text = F.aggregate(known, F.struct(text.alias("text"), F.lower(text).alias("low")), mend, lambda s: s["text"])
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, COMMA, ", "), JOINED, "$1 $2"), STOP, "$1\n")
    return F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def _rule(sequence: Column, rule: Column) -> Column:
    """Matches of one rule (licence, rule, ids) in the sequence of (pos, id)."""
    order, length = rule["ids"], F.size(rule["ids"])
    match = "array<struct<licence:string,rule:string,n:int,first:int,last:int>>"
    state = F.struct(F.lit(0).alias("k"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.array().cast(match).alias("found"))

    def step(s: Column, x: Column) -> Column:
        # k sentences are matched; the next one must be near, or a first sentence starts anew
        goes_on = (s["k"] > 0) & (x["id"] == F.try_element_at(order, s["k"] + 1)) & (x["pos"] - s["last"] <= GAP + 1)
        begins = x["id"] == F.try_element_at(order, F.lit(1))
        k = F.when(goes_on, s["k"] + 1).when(begins, 1).otherwise(s["k"])
        expected = x["id"] == F.try_element_at(order, s["k"] + 1)
        k = F.when(~goes_on & ~begins & expected, 0).otherwise(k)
        first = F.when(goes_on, s["first"]).when(begins, x["pos"]).otherwise(s["first"])
        last = F.when(goes_on | begins, x["pos"]).otherwise(s["last"])
        whole = F.struct(rule["licence"].alias("licence"), rule["rule"].alias("rule"), length.alias("n"), first.alias("first"), last.alias("last"))
        full = k == length
        found = F.when(full, F.concat(s["found"], F.array(whole))).otherwise(s["found"])
        return F.struct(F.when(full, 0).otherwise(k).alias("k"), first.alias("first"), last.alias("last"), found.alias("found"))

    return F.aggregate(sequence, state, step, lambda s: s["found"])


def scan(docs: DataFrame) -> DataFrame:
    """One row a match: doc_id, licence, rule, n_sentences, and the first and last sentence's number (from 1)."""
    text = F.col("text").cast("string")
    low = F.lower(text)
    anchored = F.lit(False)
    for word in ANCHORS:
        anchored = anchored | F.contains(low, F.lit(word))
    known = F.create_map(*[F.lit(x) for s, i in [*((s, i) for i, s in SENTENCES.items()), *WORDINGS.items()] for x in (s, i)])
    rows = docs.filter(F.coalesce(anchored, F.lit(False))).select("doc_id", sentences(text).alias("sentences"))
    numbered = F.transform("sentences", lambda s, i: F.struct((i + 1).alias("pos"), F.try_element_at(known, s).alias("id")))
    rows = rows.select("doc_id", F.filter(numbered, lambda x: x["id"].isNotNull()).alias("sequence"))
    rows = rows.filter(F.size("sequence") > 0)
    rules = F.array(
        *[F.struct(F.lit(a).alias("licence"), F.lit(b).alias("rule"), F.array(*map(F.lit, c)).alias("ids")) for a, b, c in RULES]
    )
    rows = rows.withColumn("rules", rules)
    rows = rows.select("doc_id", F.flatten(F.transform("rules", lambda r: _rule(F.col("sequence"), r))).alias("all"))
    inside = F.filter(
        "all", lambda m: ~F.exists("all", lambda o: (o["first"] <= m["first"]) & (o["last"] >= m["last"]) & (o["n"] > m["n"]))
    )
    return rows.select("doc_id", F.explode_outer(inside).alias("m")).filter("m IS NOT NULL").select(
        "doc_id", "m.licence", "m.rule", F.col("m.n").alias("n_sentences"), F.col("m.first").alias("first_sentence"), F.col("m.last").alias("last_sentence")
    )


def oracle() -> str:
    """The same matches in DuckDB SQL."""
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    rules = ", ".join(f"('{a}', '{b}', {c!r})" for a, b, c in RULES)
    anchored = " OR ".join(f"contains(lower(text), '{w}')" for w in ANCHORS)
    return rf"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
rules(licence, rule, ids) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE {anchored}),
cut AS (
  SELECT rid, doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '{COMMA}', ', ', 'g'), '{JOINED}', '\1 \2', 'g'), '{STOP}', '\1' || chr(10), 'g'), chr(10)) AS s
  FROM docs),
numbered AS (SELECT rid, doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM cut),
seq AS (
  SELECT rid, doc_id, pos, id FROM numbered
  JOIN known ON known.sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
chain(rid, doc_id, licence, rule, ids, k, first, last) AS (
  SELECT rid, doc_id, licence, rule, ids, 1, pos, pos FROM seq JOIN rules ON ids[1] = id
  UNION ALL
  SELECT c.rid, c.doc_id, licence, rule, ids, k + 1, first, n.pos
  FROM chain c JOIN seq n ON n.rid = c.rid AND n.pos > c.last AND n.pos - c.last <= {GAP + 1} AND n.id = ids[k + 1]
  WHERE NOT EXISTS (
    SELECT 1 FROM seq o WHERE o.rid = c.rid AND o.pos > c.last AND o.pos < n.pos AND (o.id = ids[1] OR o.id = ids[k + 1]))),
whole AS (SELECT rid, doc_id, licence, rule, k AS n, first, last FROM chain WHERE k = len(ids))
SELECT doc_id, licence, rule, CAST(n AS INTEGER) AS n_sentences, CAST(first AS INTEGER) AS first_sentence,
  CAST(last AS INTEGER) AS last_sentence
FROM whole m
WHERE NOT EXISTS (
  SELECT 1 FROM whole o WHERE o.rid = m.rid AND o.first <= m.first AND o.last >= m.last AND o.n > m.n)"""
