"""Archives, main text, exact top-k and surrogates."""

import base64
import gzip
import hashlib
import io
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotmerge.llm import html_text, pii, topk, warc

PAGE_SCHEMA = "page_id long, url string, html string, sha1 string, id long, value string, page long"


def pages():
    same = "<p>same ü</p>"
    rows = [(k, f"http://x/{k}", same) for k in (3, 9, 4)]
    rows += [(9, "http://x/9", same), (1, None, None), (2, "a b\r\nX: y", ""), (5, "u", "WARC/1.1\r\n\r\n"),
             (6, "u", "z" * 200_000), (None, "u", "no id"), (7, "u", "é\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n")]
    return [(*r, "x", 0, "x", 0) for r in rows]


@pytest.mark.parametrize("min_bytes", [0, 1, 1000])
def test_warc(spark, tmp_path, min_bytes):
    path = str(tmp_path / "archive")
    frame = spark.createDataFrame(pages(), PAGE_SCHEMA).repartition(3)
    got = warc.archive(frame, path, min_bytes).collect()
    best = {}
    for page, _, html, *_ in pages():
        if page is not None:
            best[html or ""] = max(best.get(html or "", page), page)
    want = Counter()
    for page, _, html, *_ in pages():
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = best.get(html or "")
        revisit = page is not None and page < first and len(payload) >= min_bytes
        want[page, len(payload), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter(tuple(r) for r in got) == want
    # What was written is a chain of whole records; responses carry the payload, revisits don't.
    found = []
    for file in (tmp_path / "archive").glob("part-*"):
        found += list(warc.parse(gzip.open(io.BytesIO(file.read_bytes()))))
    assert len(found) == len(pages())
    for fields, block in found:
        assert block.startswith(b"HTTP/1.1 200 OK\r\n")
        assert "x" not in fields  # a url cannot add header lines
        if fields["warc-type"] == "revisit":
            assert block.endswith(b"\r\n\r\n") and fields["warc-refers-to"].startswith("<urn:uuid:")


def test_warc_files_are_split(spark, tmp_path):
    """Records of one large file are read by many tasks; each is a gzip member of its own."""
    rng = np.random.default_rng(2)
    rows = [(k, f"u{k}", rng.bytes(3000).hex(), "x", 0, "x", 0) for k in range(40)]
    path = str(tmp_path / "archive")
    assert warc.archive(spark.createDataFrame(rows, PAGE_SCHEMA).coalesce(1), path).count() == 40
    files = [f.read_bytes() for f in (tmp_path / "archive").glob("part-*")]
    assert sum(len(f.split(warc.MARK)) - 1 for f in files) == 40
    for one in files[0].split(warc.MARK)[:-1]:
        assert len(list(warc.parse(io.BytesIO(gzip.decompress(one))))) == 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = warc.read(spark, path)
        assert {r["page_id"] for r in found.collect()} == set(range(40))
        tasks = found.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > len(files)


def test_warc_of_nothing(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], PAGE_SCHEMA), str(tmp_path / "a")).count() == 0


def test_damaged_archive_is_noticed():
    good = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    assert len(list(warc.parse(io.BytesIO(good.encode())))) == 1
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(good[:-9].encode())))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"junk" + good.encode())))


LONG = "A paragraph with quite a lot of words in it, so that nobody takes it for a menu or a caption."

HTML_CASES = {
    "": "", "<": "<", "plain text": "plain text", "<p>a": "a", "<!-- x": "", "<script>x": "", "a <b>c</b>": "a c",
    "<p>x<br>y</p>": "x y", "<div class='ad'>zz</div>": "", "<p>a&amp;b&nbsp;c &#0065; &apos; &am</p>": "a&b c A ' &am",
    f"<nav>Home</nav><article><h1>T</h1><p>{LONG}<p>Of.</article><footer>f</footer>": f"T\n{LONG}\nOf.",
    f"<article><p>One.</p><div class='advert'>Buy</div><p>Two.</p></article><p>{LONG}</p>": "One.\nTwo.",
    f"<body><ul><li><a href=a>Menu one</a><li><a href=b>Menu two</a></ul><div><p>{LONG}<p>Of.</div>"
    f"<aside>{LONG}</aside><div id=comments>{LONG}</div><form>{LONG}</form></body>": f"{LONG}\nOf.",
    f"<main><p>{LONG}</p><section class='related-posts'>{LONG}</section></main>": LONG,
    f"<div hidden>{LONG}</div><p title='a > b'>{LONG}</p><div role='navigation'>{LONG}</div>": LONG,
    f"<header>{LONG}</header><div class=cookie-notice><p>{LONG}</p></div><p>{LONG}<script>var t='</p>';</script>": LONG,
    f"<body class='has-sidebar'><p>{LONG}</p><style>p{{}}</style><noscript>{LONG}</noscript>": LONG,
    f"<article><p>{LONG}</p><article class='comment'>{LONG}</article></article>": LONG,
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
}


HTML_CASES |= {  # end tags of elements at any depth, tags of unknown names, links
    "<nav>" + "<a href=x>x" * 100 + f"</nav><p>{LONG}</p>": LONG,
    "<aside>" + "<fb:like/>" * 100 + f"</aside><p>{LONG}</p>": LONG,
    "<form>" + "<span>x" * 100 + f"</form><p>{LONG}</p>": LONG,
    f"<body><a name=top><p>{LONG}</p><p>{LONG}</p>": f"{LONG}\n{LONG}",
    f"<nav><a href=x>x<div>y</a></div></nav><div><p>{LONG}</p></div>": LONG,
    f"<i><article><p>One.</i><p>Two.</p></article><p>{LONG}</p>": "One.\nTwo.",
}

HTML_CASES |= {  # marks and cues are weights
    f"<main><h1>T</h1><p>{LONG}</p><p>{LONG}</p><div><article>teaser</article></div></main>": f"T\n{LONG}\n{LONG}\nteaser",
    f"<main><article><p>{LONG}</p><p>{LONG}</p></article><section><p>more</p></section></main>": f"{LONG}\n{LONG}",
    f"<div><p>{LONG}</p><div class=ad>Buy</div><p>Last one.</p><div class=share>Share</div></div>": f"{LONG}\nLast one.",
    f"<div class='elementor-widget-theme-post-content'><p>{LONG}</p></div>": LONG,
    f"<div class='widget'><article><p>{LONG}</p><p>Of.</p></article></div>": f"{LONG}\nOf.",
    f"<article><p>{LONG}</p></article><div><p>{LONG * 16}</p></div>": f"{LONG}\n{LONG * 16}",
}


TEASER = "Read next about a thing that is not this article at all. " * 23  # 1,311 characters

HTML_CASES |= {  # cued containers whatever their length; subjects that share a word with a cue
    f"<body><p>{LONG}</p><div id='comments'><p>{LONG * 12}</p><p>{LONG * 12}</p><p>{LONG * 14}</p></div></body>": LONG,
    f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG * 9}</p></div></article>": LONG,
    f"<article><p>{LONG}</p></article><div class='box'><p>{TEASER}</p></div>": LONG,
    f"<article><p>{LONG}</p><div class='google-ads'><p>{LONG * 9}</p></div><p>Of.</p></article>": f"{LONG}\nOf.",
    f"<div class='sidebar'><p>{LONG * 9}</p></div>": LONG * 9,  # nothing else is left
    "<ul>" + "<li><b><i><u><s><em><span><b><i><u><s><em><span><b><i><u><s><em><span>x" * 3 + "</ul>": "x\nx\nx",
}
HTML_CASES |= {
    f"<article><p>One.</p><div class='{name}'><p>{LONG}</p><p>Of.</p></div></article>": f"One.\n{LONG}\nOf."
    for name in ("social-history", "share-price", "related-work", "widget-guide", "banner-year", "promo", "notice")
}
HTML_CASES |= {
    f"<article><p>{LONG}</p><div class='{name}'><p>Short line</p><a href=x>{LONG}</a></div></article>": LONG
    for name in ("social-history", "share", "promo", "related-posts", "notice")
}


@pytest.mark.parametrize("html", HTML_CASES)
def test_main_text(html):
    assert html_text.main_text(html) == HTML_CASES[html]


def test_main_text_of_a_table(spark):
    rows = [(1, None, None), (2, "u", "<p>text \U0001f600</p>"), (2, "u", "<p>text \U0001f600</p>"), (None, "v", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert Counter(map(tuple, got.collect())) == Counter(
        [(1, None, "", 0), (2, "u", "text \U0001f600", 6), (2, "u", "text \U0001f600", 6), (None, "v", "", 0)])
    odd = "page_id long, url string, html string, text string, n_chars string, `batch` int"
    assert html_text.extract(spark.createDataFrame([], odd)).count() == 0
    more = html_text.extract(spark.createDataFrame([(1, "u", "<p>a</p>", "x", "y", 3)], odd))
    assert list(map(tuple, more.collect())) == [(1, "u", "a", 1)]


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<!-- ", "<div>", "</div>", "&amp;", "<p>x", "<script>", "<b><p>", "<a b='>"])
def test_markup_is_scanned_in_linear_time(part):
    start = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - start < 10


def brute_top_k(rows, k, step):
    valid = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in valid if i % step == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in valid if i != q)
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4, 8))
    rows = [(k, [float(np.float32(x)) for x in rng.choice([0.3, 1, 5]) * (base[k % 4] + 0.2 * rng.normal(size=8))]) for k in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0, None] * 4), (n + 3, [float("nan")] * 8), (n + 4, [float("inf")] * 8),
             (n + 5, [0.0] * 8), (n + 6, [1.0, -2.0]), (10, rows[10][1]), (11, rows[11][1]), (None, [1.0] * 8)]
    return rows


@pytest.mark.parametrize("bucket,block,coordinate", [(2048, 1024, 0.6), (16, 4, 0.6), (16, 4, -9.0), (16, 4, 9.0)])
def test_top_k(spark, monkeypatch, bucket, block, coordinate):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "RUN", 2)
    rows = vectors(300)
    schema = "vec_id long, embedding array<float>, id long, v string, norm double, block int"
    frame = spark.createDataFrame([(*r, 1, "x", 1.0, 1) for r in rows], schema)
    got = topk.top_k(frame, frame["vec_id"] % 10 == 0).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == brute_top_k(rows, 5, 10)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in topk.top_k(few, few["vec_id"] % 10 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    none = spark.createDataFrame([], schema)
    assert topk.top_k(none, none["vec_id"] % 10 == 0).count() == 0


@pytest.mark.parametrize("coordinate", [-9.0, 0.6, 9.0])
def test_pruning_keeps_every_best_product(coordinate):
    rng = np.random.default_rng(2)
    for _ in range(30):
        c = rng.integers(-9, 10, (60, 5))
        c = c[np.argsort(-(c**2).sum(axis=1), kind="stable")]
        q = rng.integers(-9, 10, (7, 5))
        best = topk.Best(np.arange(100, 107), q, np.full(7, topk._NO_FLOOR), 3)
        for k in range(0, 60, 15):
            best.meet(np.arange(k, k + 15), c[k : k + 15], coordinate)
        for n in range(7):
            s = c @ q[n]
            assert best.found[n] == sorted(zip((-s).tolist(), range(60), strict=True))[:3]


PII_ROWS = [
    (1, "Mail Anna.B@Corp.com and anna.b@corp.com or BOB@CORP.COM, call +1 (017) 555-7713 or 017-555-7713."),
    (2, "Mr. John Smith met Mrs Smith and Frau Müller; Mr Smith, MR nobody. господин Иванов"),
    (3, "card 4111 1111 1111 1111 and 4111111111111112, ip 192.168.1.7 and 8.8.8.8. Not 1.2.3 or 999.1.1.1"),
    (4, 'token = "05aa649a5ccdc999d156f1e99fdd25361605aa64"!! DE89 3704 0044 0532 0130 00 x'),
    (5, None), (6, ""), (7, "clean text 12 of 2.0, v 1.2.3; 12-13, 2024-05-06"),
    (1, "again anna.b@corp.com"), (1, "again anna.b@corp.com"), (None, "a@b.de"), (8, "bob@corp.com" + " word" * 40_000),
]


@pytest.fixture(scope="module")
def surrogates(spark):
    schema = "doc_id long, text string, raw string, id long, h long, news string, n_entities string"
    rows = [(*r, "x", 1, 1, "x", "x") for r in PII_ROWS]
    got = pii.pseudonymise(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(PII_ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    return by


def test_surrogates_keep_type_and_coreference(surrogates):
    import re

    one = next(r for r in surrogates[1] if r["n_entities"] == 5)
    mails = re.findall(r"[\w.]+@[\w.]+\w", one["text"])
    assert mails[0] == mails[1] != mails[2].lower() and mails[2].isupper()
    assert mails[0].split("@")[1] == mails[2].split("@")[1].lower()
    assert "corp" not in one["text"].lower()
    a, b = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\S+)\.$", one["text"]).group(1, 2), re.search(r"or (\d\S+)\.$", one["text"])[1]
    assert "-".join(a) == b != "017-555-7713"
    again = [r for r in surrogates[1] if r["n_entities"] == 1]
    assert len(again) == 2 and all(r["text"] == f"again {mails[0]}" for r in again)
    assert surrogates[8][0]["text"].startswith(mails[2].lower() + " word") and len(surrogates[8][0]["text"]) > 200_000


def test_surrogates_of_names_and_numbers(surrogates):
    import re

    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Frau (\w+); Mr (\w+), MR nobody\. господин (\w+)", surrogates[2][0]["text"])
    assert m and m[2] == m[3] == m[5] != m[4] and m[1].endswith("o")
    assert re.fullmatch("[А-Я][а-я]+", m[6]) and not {"John", "Smith", "Müller", "Иванов"} & set(m.groups())
    m = re.fullmatch(r"card (4\d{3} \d{4} \d{4} \d{4}) and (4\d{15}), ip 192\.168\.(\d+)\.(\d+) and (\S+)\. Not 1\.2\.3 or 999\.1\.1\.1", surrogates[3][0]["text"])

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])

    assert luhn(m[1]) % 10 == 0 and luhn(m[2]) % 10 != 0 and m[5] != "8.8.8.8"
    m = re.fullmatch(r'token = "([0-9a-f]{40})"!! DE(\d\d) (\d{4} ){4}\d\d x', surrogates[4][0]["text"])
    assert m and m[1] != PII_ROWS[3][1][9:49]


def test_texts_without_entities_stay(surrogates):
    assert [(surrogates[k][0]["text"], surrogates[k][0]["n_entities"]) for k in (5, 6, 7)] == [
        (None, 0), ("", 0), (PII_ROWS[6][1], 0)]
    assert surrogates[None][0]["text"] != "a@b.de"


def test_surrogates_stay_distinct_when_draws_collide(spark):
    """Eleven addresses of one letter or digit each cannot all get a draw of their own form."""
    rows = [(k, f"{c}@same.com") for k, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz")]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["text"] for r in got}) == len(rows)
    assert not {r["text"].split("@")[0] for r in got} & {t.split("@")[0] for _, t in rows}


def draws_of(spark, raws):
    docs = spark.createDataFrame(list(enumerate(raws)), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs).collect()}


def test_addresses_of_all_lengths_stay_distinct(spark):
    rng = np.random.default_rng(2)
    raws = sorted({f"192.168.{a}.{b}" for a, b in rng.integers(0, 256, (3000, 2))} | {f"10.0.{k % 256}.{k // 256}" for k in range(500)})
    got = draws_of(spark, raws)
    assert len(set(got.values())) == len(raws) and not set(got.values()) & set(raws)
    assert all(got[k].startswith(r[: r.index(".") + 1]) for k, r in enumerate(raws))


@pytest.mark.parametrize("n", [45, 80])
def test_surrogates_of_full_forms(spark, n):
    """Two digits behind the country: unused numbers while they suffice, then a permutation."""
    raws = [f"+12{k:02d}" for k in range(n)]
    got = draws_of(spark, raws)
    assert len(set(got.values())) == n and all(len(t) == 5 and t.startswith("+12") for t in got.values())
    assert all(got[k] != raws[k] for k in range(n))
    assert set(got.values()) == set(raws) if n > 50 else not set(got.values()) & set(raws)


@pytest.mark.parametrize("raw, kind", [
    ("FR14 2004 1010 0505 0001 3M02 606", "iban"), ("IT60 X054 2811 1010 0000 0123 456", "iban"), ("NO93 8601 1117 947", "iban"),
    ("MT84 MALT 0110 0001 2345 MTLC AST0 01S", "iban"), ("IT60X0542811101000000123456", "iban"), ("BE68 5390 0754 7034", "iban"),
    ("MU17 BOMM 0101 1010 3030 0200 000M UR", "iban"), ("SC18 SSCB 1101 0000 0000 0000 1497 USD", "iban"),
    ("3714 496353 98431", "card"), ("3714-496353-98431", "card"), ("3056 930902 5904", "card"),
])
def test_patterns_match_whole_entities(spark, raw, kind):
    docs = spark.createDataFrame([(f"pay {raw} EUR, now",)], "text string")
    found = docs.select(F.regexp_extract_all("text", F.lit(pii.PATTERN), F.lit(0)).alias("r"), pii.type_of(F.lit(raw)).alias("k")).first()
    assert found["r"] == [raw] and found["k"] == kind


def test_surrogates_of_nothing(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string")).count() == 0
