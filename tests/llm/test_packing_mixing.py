"""Packing and mixing against brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotmerge.llm import mixing, packing


def test_packing(docs, no_docs):
    tokenizer = packing.tokenizer_by_merges("byte_bpe_50k")
    got = packing.pack_documents(docs).collect()
    pieces, total = defaultdict(list), 0
    for r in got:
        pieces[r["doc_id"], r["piece"], r["ids_crc32"]].append(r)
    n = 0
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        cuts = [(0, min(first, len(ids)))] + [(s, 2048) for s in range(first, len(ids), 2048)]
        for k, (start, length) in enumerate(cuts):
            p = pieces[r["doc_id"], k, zlib.crc32(ids[start : start + length].tobytes())].pop()
            assert (p["start"], p["length"]) == (start, length)
            n += 1
    assert n == len(got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack_documents(no_docs).count() == 0


def test_ids_on_demand(docs):
    rows = packing.pieces(docs, with_ids=True).where("doc_id = 5").collect()
    assert [len(r["ids"]) for r in rows] == [r["length"] for r in rows]


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a<|endoftext|> b", "it's 12 °C\r\n\u0085 ", " " * 5000])
def test_both_tokenizers_agree(text):
    slow = packing.tokenizer_by_merges("byte_bpe_50k").encode(text, add_special_tokens=False).ids
    assert packing.token_ids(text).tolist() == slow


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_both_tokenizers_agree_on_any_text(text):
    slow = packing.tokenizer_by_merges("byte_bpe_50k").encode(text, add_special_tokens=False).ids
    assert packing.token_ids(text).tolist() == slow


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [k for k, g in enumerate(gaps) if g >= length]
        if fitting:
            gaps[min(fitting, key=lambda k: gaps[k])] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_runs_are_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = defaultdict(list)
    seen = defaultdict(list)
    for length, rank, n, fold, sequence, offset in packing.best_fit_runs(counts, 20).tolist():
        for k in range(n):
            used[sequence + k // fold].append((offset + k % fold * length, length))
            seen[length].append(rank + k)
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 20
    assert len(used) == best_fit_decreasing(lengths, 20)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    fixed, open_ = {}, set(names)
    while open_:
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > 2 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / whole for s in open_}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            open_.discard(s)
    return fixed


def test_mixing(docs, no_docs):
    rows = docs.collect()
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
    want = brute_targets(dict(sizes))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        reachable = {0}
        for r in got:
            if r["source"] == s:
                reachable |= {x + r["size"] for x in reachable}
        whole = int(min(want[s] // max(sizes[s], 1), 2))
        best = min(abs(whole * sizes[s] + x - want[s]) for x in reachable)
        assert abs(taken[s] - want[s]) <= best + 1
    key = lambda r: (r["id"] is None, r["id"], r["source"] or "", r["copies"])
    assert sorted(got, key=key) == sorted(mixing.mix(docs.repartition(5)).collect(), key=key)
    assert mixing.mix(no_docs).count() == 0


def test_draw_takes_as_often_as_planned(docs, no_docs):
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    plan = {(r["id"], r["source"], r["size"]): r["copies"] for r in mixing.mix(docs).collect() if r["id"] not in (None, 61)}
    ids = [r["doc_id"] for r in drawn.collect()]
    assert all(ids.count(i) == n for (i, _, _), n in plan.items())
    assert mixing.draw(no_docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=8), st.floats(0, 1), st.integers(0, 5))
def test_budget_is_met_as_near_as_can_be(counts, share, seed):
    lengths = np.array(sorted(counts), np.int64)
    have = np.array([counts[n] for n in lengths], np.int64)
    budget = round(share * float((lengths * have).sum()))
    take = mixing._subset_sum(lengths, have, budget)
    assert (take >= 0).all() and (take <= have).all()
    reachable = {0}
    for n, c in counts.items():
        for _ in range(c):
            reachable |= {x + n for x in reachable}
    assert abs(int((take * lengths).sum()) - budget) == min(abs(x - budget) for x in reachable)
    fitted = mixing.fit_budget(lengths, have, budget, seed)
    assert (fitted >= 0).all() and (fitted <= have).all()
    assert abs(int((fitted * lengths).sum()) - budget) <= lengths.max()
