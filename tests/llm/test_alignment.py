"""Tokenizer alignment against brute force."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plotmerge.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level():
    """Characters of the byte-level alphabet to bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


ALPHABET = byte_level()


def tokens(text):
    """(id, bytes) of both sides, or None."""
    if not text:
        return None
    e = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(ALPHABET[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(t for _, t in side) == whole for side in (a, b)) else None


def groups(a, b):
    """Lists of (A ids, B ids), token by token."""
    out, x, y, at_a, at_b = [], [], [], 0, 0
    a, b = list(a), list(b)
    while a or b:
        if at_a <= at_b:
            i, t = a.pop(0)
            x.append(i)
            at_a += len(t)
        else:
            i, t = b.pop(0)
            y.append(i)
            at_b += len(t)
        if at_a == at_b:
            out.append((x, y))
            x, y = [], []
    return out


def brute(docs):
    found = [(d, tokens(t)) for d, t in docs]
    cut = [(d, t, groups(*t) if t else []) for d, t in found]
    counts = Counter((x[-1], y[-1]) for _, _, g in cut for x, y in g)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for d, t, g in cut:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        links = [(x[-1], y[-1]) for x, y in g]
        out.append((
            d, len(t[0]) if t else 0, len(t[1]) if t else 0, len(g), len(links),
            sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if t else "",
        ))
    return sorted(out, key=repr), counts, highest


NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
HARD = ["<|endoftext|> and </s> <s> <0x41>", "a▁b", " ", "  two", "tab\tand\r\nline\x00", "é 　 ﬁ",
        "\U0001f600\U0001f601 and 中文字", "<unk>", "x" * 300]


@pytest.mark.parametrize("spill_records, slice_bytes, fan_in, block", [
    (2_000_000, 8_000_000, 64, 65_536), (50, 200, 2, 7),
])
def test_alignment_matches_brute_force(spark, docs, monkeypatch, spill_records, slice_bytes, fan_in, block):
    from fixtures import DOC_SCHEMA, _EXTRA, frame

    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    monkeypatch.setattr(alignment, "BLOCK", block)
    more = frame(spark, [(900 + k, t, "en", "a", 0) + _EXTRA for k, t in enumerate(HARD)], DOC_SCHEMA)
    every = docs.where("length(text) < 3000 or text is null").unionByName(more).repartition(5)
    want, counts, highest = brute([(r["doc_id"], r["text"]) for r in every.collect()])
    got, pairs = alignment.align_documents(every, spill_records=spill_records, slice_bytes=slice_bytes)
    assert sorted((tuple(r[n] for n in NAMES) for r in got.collect()), key=repr) == want
    table = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in pairs.collect()}
    assert table == {p: (n, n == highest[p[1]]) for p, n in counts.items()}


def test_empty_tables(spark, no_docs):
    got, pairs = alignment.align_documents(no_docs)
    assert got.count() == 0 and pairs.count() == 0
    got, pairs = alignment.align_documents(
        spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"))
    assert sorted(map(tuple, got.drop("row").collect()), key=repr) == sorted(
        [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)
    assert pairs.count() == 0


def test_very_long_texts(docs):
    long = docs.where("length(text) >= 40000")
    want, *_ = brute([(r["doc_id"], r["text"]) for r in long.collect()])
    got, _ = alignment.align_documents(long)
    assert sorted((tuple(r[n] for n in NAMES) for r in got.collect()), key=repr) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_groups_of_any_text(text):
    both = alignment.tokenizers()
    found, t = alignment.align(text, both), tokens(text)
    assert (found is None) == (t is None)
    if t:
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups(*t))
        assert alignment.spell(*found, both).decode() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=40), min_size=1, max_size=9))
def test_merge_sums_every_key(runs):
    want = Counter()
    for run in runs:
        for k, n in run:
            want[k] += n

    def stream(run):
        run = sorted(run)
        for k in range(0, len(run), 3):
            keys, n = zip(*run[k : k + 3], strict=True)
            yield np.array(keys, np.uint64), np.array(n, np.uint32)

    got = [(int(k), int(n)) for keys, ns in alignment.merge(list(map(stream, runs)))
           for k, n in zip(keys, ns, strict=True)]
    assert got == sorted(want.items())
