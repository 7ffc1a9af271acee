"""Small tables with the hard cases: nulls, empty and long texts, ties, repeats, odd names."""

import random

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " id long, row long, digest string, size long, _digest string, _kept long, _mix_id long,"
    " _lines_id long, _pii_id long, _p double, h long, copies long, toxic int, `class` string"
)
_EXTRA = (7, 7, "x", 7, "x", 7, 7, 7, 7, 0.5, 7, 7, 1, "x")
WORDS = "the of and that with for was ever under house tree river stone light north cold blue seven".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


def documents(n=60, seed=1):
    """Rows of the documents table, with helper-like names beside its own."""
    rng = random.Random(seed)
    rows = [(k, "\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 4))),
             "en", rng.choice(["a", "a", "a", "b", "é", None]), 0) for k in range(n)]
    base = rows[3][1]
    rows += [
        (n, base, "en", "a", 0), (n + 1, base, None, None, None),  # copies
        (n + 1, base, None, None, None),  # a repeated row
        (n + 2, None, None, None, None), (n + 3, "", "en", "b", 0), (n + 4, " \t\n ", "en", "b", 0),
        (n + 5, "x", "en", "é", 1), (n + 6, "word " * 30_000, "en", "a", 0),
        (n + 7, "y" * 50_000, "en", "b", 0), (None, "without an id", "en", "a", 0),
        (n + 8, base.replace("the", "thy", 1), "en", "a", 0),
        (n + 9, "Zu Ähren und mehr \U0001f600 <|endoftext|> ok", "de", "c", 0),
    ]
    return [r + _EXTRA for r in rows]


def frame(spark, rows, schema=DOC_SCHEMA):
    return spark.createDataFrame(rows, schema)
