"""Licence scan: which licences a document names or quotes.

Base phrases are found wherever their words stand consecutively. Beyond them, templates (short
stable parts of well-known licences) are found by a positional index of rare words:

1. every word of a template is counted over all documents, which gives its IDF;
2. of each template the half of its words with the highest IDF (``RARE_WORDS`` at most) is indexed
   by place;
3. a document looks up all of its words that are indexed; each posting votes for one relative
   position of one template, with the word's IDF;
4. a relative position with at least half of the template's indexed IDF is a candidate;
5. a candidate counts if all mandatory key phrases of the template stand at their places there.

A template's score is the share of its indexed IDF that agrees on the position; the document's
score is the highest of its templates, or 1 if it holds a base phrase, or 0.

Votes and key phrases are rows summed by (document, template, position), with partial sums before
the shuffle, so nothing depends on how many documents carry one licence. The templates, their
postings and the counts of their words are bounded by the templates given, not by the data.
DataFrame functions only.

Defined results: null text is empty; an empty document has no words, no labels and score 0;
repeated rows are told apart by their place in the table; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmerge.llm.common import stored, whole_text

#: Indexed words of one template, at most.
RARE_WORDS = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A stable passage of a licence; every key phrase is part of the passage."""

    label: str
    text: str
    keys: tuple[str, ...]


#: The phrases of the contract and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Passages of public licences and licence notices.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software",
        ("free of charge to any person obtaining a copy", "deal in the software without restriction"),
    ),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the"
        " License at http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "the following conditions are met"),
    ),
    Template(
        "bsd-3-clause",
        "may be used to endorse or promote products derived from this software without specific prior"
        " written permission",
        ("endorse or promote products derived from this software",),
    ),
    Template(
        "gpl-2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation;"
        " either version 2 of the License, or (at your option) any later version",
        ("gnu general public license", "version 2 of the license"),
    ),
    Template(
        "gpl-3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation,"
        " either version 3 of the License, or (at your option) any later version",
        ("gnu general public license", "version 3 of the license"),
    ),
    Template(
        "lgpl-2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software"
        " Foundation; either version 2.1 of the License, or (at your option) any later version",
        ("gnu lesser general public license", "version 2 1 of the license"),
    ),
    Template(
        "agpl-3",
        "under the terms of the GNU Affero General Public License as published by the Free Software"
        " Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu affero general public license", "version 3 of the license"),
    ),
    Template(
        "mpl-2",
        "subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"
        " fee is hereby granted, provided that the above copyright notice and this permission notice"
        " appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "unlicense", "This is free and unencumbered software released into the public domain",
        ("unencumbered software released into the public domain",),
    ),
    Template("bsl-1", "Boost Software License - Version 1.0", ("boost software license",)),
    Template("cc0-1", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template(
        "cc-by", "licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ("creative commons attribution sharealike",),
    ),
    Template(
        "cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        ("creative commons attribution noncommercial 4 0",),
    ),
)


def split_words(text: str) -> list[str]:
    """The words of a template or phrase, as ``words`` finds them in a column."""
    lower = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(NOT_A_WORD, lower) if w]


def place(phrase: list[str], within: list[str]) -> int:
    """Where a phrase first stands in a list of words."""
    for k in range(len(within) - len(phrase) + 1):
        if within[k : k + len(phrase)] == phrase:
            return k
    raise ValueError(f"{' '.join(phrase)!r} is not part of its template")


def words(text: Column) -> Column:
    """The words of whole texts, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_A_WORD), "")


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _places(phrase: list[str], at: str = "_words", spelled: str = "_spelled") -> Column:
    """Starts of a phrase; only texts that contain it are searched by word."""
    none = F.array().cast("array<int>")
    if not phrase:
        return none
    last = F.size(at) - len(phrase)

    def stands(i: Column) -> Column:
        same = F.get(F.col(at), i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            same = same & (F.get(F.col(at), i + k) == word)
        return same

    return F.when(
        F.contains(F.col(spelled), F.lit(" ".join(phrase))), F.filter(F.sequence(F.lit(0), last), stands)
    ).otherwise(none)


def document_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict]:
    """How many documents there are, and how many hold each word of the vocabulary."""
    held = F.array_intersect(words(whole_text(text_col)), _array(vocabulary))
    # The empty word stands for the document itself.
    rows = docs.select(F.explode(F.array_append(held, "")).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def rare_words(templates: list[list[str]], n: int, counts: dict[str, int]) -> list[list[tuple]]:
    """Of each template, (word, place, IDF in thousandths) of its words with the highest IDF."""
    idf = {w: math.floor(1000 * math.log((n + 1) / (counts.get(w, 0) + 1))) for t in templates for w in t}
    index = []
    for found in templates:
        distinct = sorted(set(found), key=lambda w: (-idf[w], w))
        kept = set(distinct[: min(RARE_WORDS, -(-len(distinct) // 2))])
        index.append([(w, k, idf[w]) for k, w in enumerate(found) if w in kept])
    return index


def _scanned(docs: DataFrame, id_col: str, text_col: str, base, keys, indexed: list[str]) -> DataFrame:
    """Per document what the later steps need of its text, stored; the text itself goes no further."""
    found = docs.select(
        F.col(id_col).cast("long").alias("id"), words(whole_text(text_col)).alias("_words")
    ).withColumn("_spelled", F.array_join("_words", " "))

    none = F.array().cast("array<struct<k:int,at:int>>")

    def numbered(k: int, phrase: list[str]) -> Column:
        return F.transform(_places(phrase), lambda i: F.struct(F.lit(k).alias("k"), i.alias("at")))

    def tagged(phrases: list[list[str]]) -> Column:
        found = [numbered(k, p) for k, p in enumerate(phrases)]
        return F.flatten(F.array(*found)) if found else none

    hits = F.array_compact(F.transform(
        "_words", lambda w, i: F.when(w.isin(indexed), F.struct(w.alias("word"), i.alias("at")))
    ))
    # Without an indexed word there is no vote that a key phrase could confirm.
    votes = F.arrays_overlap("_words", _array(indexed))
    no_hits = F.array().cast("array<struct<word:string,at:int>>")
    return stored(
        found.select(
            F.monotonically_increasing_id().alias("_row"), "id",
            F.size("_words").cast("long").alias("n_words"),
            tagged([split_words(p) for _, p in base]).alias("_base"),
            F.when(votes, tagged(keys)).otherwise(none).alias("_keys"),
            F.when(votes, hits).otherwise(no_hits).alias("_hits"),
        ),
        "licence-places",
    )


def _template_labels(scanned: DataFrame, templates, index, keys: list[list[str]]) -> DataFrame:
    """Rows (_row, _labels, _score): the templates that documents hold."""
    spark = scanned.sparkSession
    postings = spark.createDataFrame(
        [(w, t, at, idf) for t, found in enumerate(index) for w, at, idf in found],
        "word string, t int, q int, idf bigint",
    )
    key_postings = spark.createDataFrame(
        [(keys.index(split_words(key)), t, place(split_words(key), split_words(template.text)))
         for t, template in enumerate(templates) for key in template.keys],
        "k int, t int, q int",
    )
    totals = spark.createDataFrame(
        [(t, template.label, sum(idf for *_, idf in found), len(template.keys))
         for t, (template, found) in enumerate(zip(templates, index, strict=True))],
        "t int, label string, total bigint, n_keys bigint",
    )
    # Postings and totals are bounded by the templates.
    votes = scanned.select("_row", F.inline("_hits")).join(F.broadcast(postings), "word")
    checks = scanned.select("_row", F.inline("_keys")).join(F.broadcast(key_postings), "k")
    position = (F.col("at") - F.col("q")).alias("position")
    both = votes.select("_row", "t", position, "idf", F.lit(0).alias("key")).unionByName(
        checks.select("_row", "t", position, F.lit(0).cast("long").alias("idf"), F.lit(1).alias("key"))
    )
    held = (
        both.groupBy("_row", "t", "position").agg(F.sum("idf").alias("mass"), F.sum("key").alias("n"))
        .join(F.broadcast(totals), "t")
        .where((F.col("mass") * 2 >= F.col("total")) & (F.col("n") == F.col("n_keys")))
    )
    share = F.when(F.col("total") > 0, F.col("mass") / F.col("total")).otherwise(1.0)
    return held.groupBy("_row").agg(
        F.collect_set("label").alias("_labels"), F.max(share).alias("_score")
    )


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE,
    templates: tuple[Template, ...] = TEMPLATES,
) -> DataFrame:
    """Every document with the places of base phrases, its labels and its score."""
    passages = [split_words(t.text) for t in templates]
    keys = [list(k) for k in dict.fromkeys(tuple(split_words(k)) for t in templates for k in t.keys)]
    vocabulary = sorted({w for p in passages for w in p})
    index = rare_words(passages, *document_counts(docs, vocabulary, text_col))
    indexed = sorted({w for found in index for w, *_ in found})
    scanned = _scanned(docs, id_col, text_col, base, keys, indexed)
    own = _template_labels(scanned, templates, index, keys).withColumnRenamed("_row", "_own_row")
    names = _array([label for label, _ in base])
    base_labels = F.transform("_base", lambda b: F.get(names, b["k"]))
    labels = F.array_union(base_labels, F.coalesce("_labels", F.array().cast("array<string>")))
    starts = F.transform("_base", lambda b: b["at"].cast("long"))
    return scanned.join(own, F.col("_row") == F.col("_own_row"), "left").select(
        "id", "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
