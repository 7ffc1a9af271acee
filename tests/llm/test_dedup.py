"""Exact dedup, SimHash and line dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plotmerge.llm import exact_dedup, line_dedup, simhash
from plotmerge.llm.common import components, rank_in_class


def text_of(r):
    return r["text"] or ""


@pytest.mark.parametrize("split", ["half", "none", "all"])
def test_exact_dedup(docs, split):
    earlier = {"half": exact_dedup.earlier_half(docs), "none": None, "all": F.lit(True)}[split]
    got = exact_dedup.exact_dedup(docs, earlier=earlier).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(text_of(r).encode()).digest()].append(r["doc_id"])
    for digest, ids in groups.items():
        mine = [g for g in got if bytes(g["digest"]) == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert Counter(g["id"] for g in mine) == Counter(ids)
        assert {g["keep_id"] for g in mine} == {best}
        assert {g["group_size"] for g in mine} == {len(ids)}
        assert [g["id"] for g in mine if g["kept"]] == [best]


def test_exact_dedup_drops_repeated_rows(docs, no_docs):
    kept = exact_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns
    texts = [text_of(r) for r in kept.collect()]
    assert Counter(texts) == Counter({text_of(r) for r in docs.collect()})
    assert exact_dedup.drop_repeats(no_docs).count() == 0
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_lookup_compares_bytes():
    """A digest that is not in the index still lands in a slot, and is not taken for a repeat."""
    def digests(names):
        return pa.array([hashlib.sha256(n.encode()).digest() for n in names], pa.binary())

    def groups(names, **more):
        n = len(names)
        return pa.table({"digest": digests(names), "id": pa.array(range(n), pa.int64()),
                         "row": pa.array(range(n), pa.int64()), "n": pa.array([1] * n, pa.int64()), **more})

    old = [f"old {k}" for k in range(5000)]
    index = exact_dedup._build(groups(old, part=pa.array([0] * 5000, pa.int32())))
    slots = exact_dedup._slots(exact_dedup._words(groups(old)["digest"]), index["levels"][0].as_py())
    assert sorted(slots) == list(range(5000))  # minimal and perfect
    looked = exact_dedup._look_up(groups(old[:100] + [f"new {k}" for k in range(2000)]), index)
    assert looked["known"].to_pylist() == [True] * 100 + [False] * 2000
    assert looked["old_id"].to_pylist()[:100] == list(range(100))
    strangers = exact_dedup._slots(
        exact_dedup._words(groups([f"new {k}" for k in range(2000)])["digest"]), index["levels"][0].as_py())
    assert (strangers >= 0).any()


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 4 else [" ".join(words[k : k + 4]) for k in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(fps))]


def test_simhash(docs, no_docs):
    rows = [r for r in docs.collect() if len(text_of(r)) < 20_000]
    small = docs.where("coalesce(length(text), 0) < 20000")
    fps = [brute_fingerprint(text_of(r)) for r in rows]
    roots = brute_components(fps)
    ids = defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        ids[root].append(r["doc_id"])
    want = Counter(
        (r["doc_id"], fp, min((i for i in ids[root] if i is not None), default=None))
        for r, fp, root in zip(rows, fps, roots, strict=True)
    )
    got = simhash.near_duplicates(small).collect()
    assert Counter((g["id"], g["fp"] % 2**64, g["component_id"]) for g in got) == want
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_simhash_keeps_one_row_of_each_component(spark):
    """Id 7 is the smallest of one component and another row's id in the component of 3."""
    one, two = ([f"{w}{k}" for k in range(200)] for w in ("left", "right"))
    near = " ".join(one[:-1] + ["end"])
    rows = [(3, " ".join(one)), (7, near), (7, " ".join(two)), (9, " ".join(two)), (7, " ".join(two)), (7, " ".join(two[:-1] + ["end"]))]
    assert all(bin(brute_fingerprint(a) ^ brute_fingerprint(b)).count("1") <= 4 for a, b in ((rows[0][1], near), (rows[2][1], rows[5][1])))
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 7]
    assert next(r["text"] for r in kept if r["doc_id"] == 7).startswith("right")


def test_simhash_long_text_in_steps():
    text = " ".join(str(k % 977) for k in range(70_000))
    words = text.split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(len(words) - 3)], np.uint64)
    votes = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=int)
    assert simhash.fingerprint(text) == int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def test_simhash_large_groups_meet_by_chunks(spark):
    """Links between all chunks of a key are found, and the pivots drop none."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 8, np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    e = components(simhash.links(nodes, group=16), "test").collect()
    found = {r["u"] % 2**64: r["v"] % 2**64 for r in e}
    classes, want = defaultdict(set), defaultdict(set)
    for f, root in zip(fps, brute_components(fps), strict=True):
        want[root].add(f)
        classes[found.get(f, f)].add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_hubs_and_nothing(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (2001, 2000)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 1000 for k in range(1001, 1300)}, 2001: 2000}
    assert components(spark.createDataFrame([], "u long, v long"), "test").count() == 0


def test_rank_in_class(spark):
    rows = [(None if k % 7 == 0 else k % 3, k * 7919 % 1000) for k in range(500)]
    got = rank_in_class(spark.createDataFrame(rows, "k int, _h long"), ["k"], "test").collect()
    ranks = defaultdict(list)
    for r in got:
        ranks[r["k"]].append((r["_rank"], r["_h"]))
    for found in ranks.values():
        found.sort()
        assert [n for n, _ in found] == list(range(len(found)))
        assert [h for _, h in found] == sorted(h for _, h in found)


def brute_lines(rows):
    occurrences = defaultdict(list)
    for r in rows:
        for k, line in enumerate(text_of(r).split("\n")):
            if line.strip(" "):
                occurrences[line].append((r["doc_id"] is not None, r["doc_id"], k))
    lines = list(occurrences)
    sets = [{s[k : k + 7] for k in range(max(1, len(s) - 6))} for s in lines]
    label = list(range(len(lines)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    classes = defaultdict(list)
    for k, line in enumerate(lines):
        classes[root(k)] += occurrences[line]
    return classes


def test_line_dedup(docs, no_docs):
    rows = docs.collect()
    want = Counter()
    for found in brute_lines(rows).values():
        found.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        for _, doc, line in found:
            want[doc, line, found[0][1], found[0][2], len(found)] += 1
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == sum(len(text_of(r).split("\n")) for r in rows)
    judged = [g for g in got if g["class_size"] is not None]
    assert Counter((g["id"], g["line"], g["keep_id"], g["keep_line"], g["class_size"]) for g in judged) == want
    assert sum(g["kept"] for g in judged) == len(brute_lines(rows))
    assert all(g["kept"] for g in got if g["class_size"] is None)
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_line_dedup_of_large_meetings(spark, monkeypatch):
    """Many near copies of one line go through leaders and end in one class."""
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(words[:k] + ["other"] + words[k + 1 :])) for k in range(60)]
    other = [(100 + k, " ".join(f"{k}term{j}" for j in range(30))) for k in range(5)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows + other, "doc_id long, text string")).collect()
    assert {g["keep_id"] for g in got if g["id"] < 100} == {0}
    assert all(g["kept"] for g in got if g["id"] >= 100)


def test_line_dedup_of_drifting_chains(spark, monkeypatch):
    """Variants that drift off a template meet in one bucket only: no link between them is lost."""
    for name, value in (("SMALL", 3), ("LEADERS", 2), ("CHUNK", 16)):
        monkeypatch.setattr(line_dedup, name, value, raising=False)
    rng, texts = np.random.default_rng(11), []
    for chain in range(3):
        words = [f"term{chain}x{k}" for k in range(24)]
        for _ in range(20):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.integers(0, 24)] = f"new{rng.integers(0, 10**6)}"
    rows = list(zip(rng.permutation(len(texts)).tolist(), texts, strict=True))
    content = spark.createDataFrame(rows, "h long, content string")
    met = content.select(F.lit(1).cast("long").alias("bucket"), "h", F.lit(len(rows)).cast("long").alias("n"))
    found = {r["u"]: r["v"] for r in components(line_dedup.links(met, content), "test").collect()}
    want = {}
    for places in brute_lines([{"doc_id": h, "text": t} for h, t in rows]).values():
        want |= {h: min(places)[1] for _, h, _ in places}
    assert {h: found.get(h, h) for h, _ in rows} == want


def test_line_dedup_of_lines_of_all_lengths(spark):
    """Signatures do not depend on which lines are hashed together; a very long line is whole."""
    rng = np.random.default_rng(5)
    texts = ["a", "ab", "abcdefg", "\u20ac" * 9, "\U0001f600 smile", "x" * 100_000,
             "".join(rng.choice(list("abc \u00e9"), 70_000)), *(f"line {k} " * (k + 1) for k in range(30))]
    for tell in (line_dedup.signature, line_dedup.sketch):
        together = tell(texts)
        assert all(np.array_equal(tell([text])[0], together[k]) for k, text in enumerate(texts))
    rows = [(k, t) for k, t in enumerate([*texts, texts[6][:-5] + "other"])]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines([{"doc_id": k, "text": t} for k, t in rows])
    assert sum(g["kept"] for g in got) == len(want) < len(rows)
    assert {g["id"]: g["keep_id"] for g in got}[len(texts)] == 6


def test_sketches_discard_no_link(spark):
    """A pair that the sketches discard is below the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(str(rng.integers(0, 9)) if rng.random() < p else w for w in base) for p in (0, 0.02, 0.05, 0.1) for _ in range(20)]
    texts = sorted(set(texts) | {"abcdefg", "abcdefgh", "abc"})
    content = spark.createDataFrame(list(enumerate(texts)), "h long, content string")
    rows = line_dedup.sketches(content)
    pairs = rows.join(rows.toDF(*[f"r_{c}" for c in rows.columns]), F.col("h") < F.col("r_h"))
    open_pairs = {(r["h"], r["r_h"]) for r in pairs.where(line_dedup._may_be_similar()).collect()}
    sets = [{s[k : k + 7] for k in range(max(1, len(s) - 6))} for s in texts]
    close = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert close and close <= open_pairs and len(open_pairs) < len(sets) * (len(sets) - 1) // 2


def test_line_dedup_signs_each_line_once(spark, monkeypatch):
    """A line of many documents is signed once, not once for each document."""
    signed, real = [], line_dedup.signatures
    monkeypatch.setattr(line_dedup, "signatures", lambda texts: signed.append(texts.count()) or real(texts))
    rows = [(k, f"a line of every document\n\nline {k} of its own, {'x' * k}") for k in range(9)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert signed == [10]
    assert {(g["keep_id"], g["class_size"]) for g in got if g["line"] == 0} == {(0, 9)}


def test_line_dedup_texts(docs):
    new = line_dedup.without_repeats(docs)
    assert new.columns == docs.columns and new.count() == docs.count()
    seen = Counter(line for r in new.collect() for line in text_of(r).split("\n") if line.strip(" "))
    classes = brute_lines(docs.collect())
    # Rows that repeat an id and text keep the same lines, others keep one of each class.
    assert len(seen) == len(classes)
