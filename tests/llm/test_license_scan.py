"""Licence scan against brute force."""

import math
import re
from collections import Counter

import pytest

from plotmerge.llm import license_scan
from plotmerge.llm.license_scan import BASE, TEMPLATES, Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def starts(phrase, words):
    return [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]


def brute(texts, templates=TEMPLATES, base=BASE):
    """Rows of the contract, every template laid on every place of every text."""
    docs = [split(t) for t in texts]
    passages = [split(t.text) for t in templates]
    held = Counter(w for d in docs for w in set(d))
    idf = {w: math.floor(1000 * math.log((len(docs) + 1) / (held[w] + 1))) for p in passages for w in p}
    out = []
    for d in docs:
        found = [(k, label) for label, phrase in base for k in starts(split(phrase), d)]
        labels, score = {label for _, label in found}, float(bool(found))
        for t, p in zip(templates, passages, strict=True):
            order = sorted(set(p), key=lambda w: (-idf[w], w))
            rare = set(order[: min(license_scan.RARE_WORDS, -(-len(order) // 2))])
            total = sum(idf[w] for w in p if w in rare)
            for at in range(-len(p), len(d)):
                agree = [w for q, w in enumerate(p) if w in rare and 0 <= at + q < len(d) and d[at + q] == w]
                mass = sum(idf[w] for w in agree)
                keys = [split(k) for k in t.keys]
                there = all(at + starts(k, p)[0] in starts(k, d) for k in keys)
                if agree and there and mass * 2 >= total:
                    labels.add(t.label)
                    score = max(score, mass / total if total else 1.0)
        at = [k for k, _ in found]
        out.append((len(d), len(found), min(at, default=None), max(at, default=None),
                    ",".join(sorted({b for _, b in found})), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=repr)


def rows(df):
    names = "n_words n_base first_word last_word base_labels labels".split()
    return sorted(((*[r[n] for n in names], round(r["score"], 9)) for r in df.collect()), key=repr)


N_ISC = len(split(TEMPLATES[11].text))
NOTICES = [
    "x released UNDER the MIT\nlicense, under the mit license. apache license version 2",
    "Licensed under CC-BY-NC 4.0",
    "under the mits license",
    "cc by nc by nc cc by nc",
    "Prose. " + TEMPLATES[1].text + ". More prose.",
    TEMPLATES[1].text.replace("rights to use, copy, modify", "right to use and alter"),
    "# " + TEMPLATES[3].text.replace("\n", "\n# ") + "\n# Unless required",
    TEMPLATES[4].text + "\n" + TEMPLATES[5].text,
    "This program is free software: redistribute " + TEMPLATES[7].text,
    "the license of the mit is not the license of the house and any copy of this is free",
    "software license license license version version boost software",
    "Boost Software License - Version 1.0 - August 17th, 2003",
]


def test_scan_matches_brute_force(spark, docs):
    from fixtures import DOC_SCHEMA, _EXTRA, frame

    notices = frame(spark, [(1000 + k, t, "en", "a", 0) + _EXTRA for k, t in enumerate(NOTICES)], DOC_SCHEMA)
    every = docs.where("length(text) < 40000 or text is null").unionByName(notices)
    got = license_scan.scan(every)
    assert rows(got) == brute([r["text"] for r in every.collect()])
    by_id = {r["id"]: r["labels"] for r in got.collect()}
    assert by_id[1000] == "apache-2,mit"
    assert [by_id[1000 + k] for k in range(4, 12)] == [
        "mit", "mit", "apache-2", "bsd,bsd-3-clause", "gpl-3", "", "", "bsl-1",
    ]


def test_very_long_texts_and_empty_tables(spark, docs, no_docs):
    assert license_scan.scan(no_docs).count() == 0
    long = "word " * 300_000 + TEMPLATES[11].text + " under the mit license" * 20_000
    row = license_scan.scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (row["n_base"], row["first_word"], row["labels"]) == (20_000, 300_000 + N_ISC, "isc,mit")
    assert row["last_word"] == 300_000 + N_ISC + 4 * 19_999
    assert license_scan.scan(docs).count() == docs.count()


def test_words_that_every_document_holds_still_vote(spark):
    """One licence in all documents: its words have IDF 0, and the position still counts."""
    texts = [f"{k} Licensed under the Apache License, Version 2.0" for k in range(20)] + [None]
    df = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    got = license_scan.scan(df, base=())
    assert rows(got) == brute(texts[:20], base=())
    assert {r["labels"] for r in got.collect()} == {"apache-2"}


def test_phrases_that_overlap_themselves(spark):
    df = spark.createDataFrame([(1, "a a a b a a")], "doc_id long, text string")
    row = license_scan.scan(df, base=(("x", "a a"),), templates=(Template("y", "b a a", ("b a",)),)).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (3, 0, 4, "x,y")


def test_key_phrases_must_be_part_of_the_template():
    with pytest.raises(ValueError):
        license_scan.place(["no"], ["a", "b"])
