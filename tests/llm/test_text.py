import gzip
import hashlib
import io
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import license_scan, mixing, quality, toxicity, url_cascade, warc
from lattica.llm.common import crc_bucket, table
from lattica.llm.ftrl import Ftrl, sigmoid
from lattica.llm.html_extract import extract_text, main_text
from lattica.llm.license_scan import TEMPLATES, align, scan_licenses, words_of
from lattica.llm.quality import quality_scores
from lattica.llm.toxicity import fit_label_model, toxicity_scores
from lattica.llm.url_cascade import RULES, judge_urls

from . import brute

# ---- archives ----


def captures():
    long = "é" * 120
    trap = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "y" * 50
    return [
        (5, "http://a.example/1", long, "s"), (2, "http://a.example/2", long, "s"), (9, "http://a.example/3", long, "s"),
        (1, "http://b.example", "short", "s"), (3, "http://b.example", "short", "s"),
        (4, None, None, None), (6, "http://c.example/\r\nWARC-Type: request", "", "s"), (7, "nonsense", trap, "s"), (8, "u", trap, "s"),
        (10, "u", "z" * 400_000, "s"), (11, "u", "a" * 100, "s"), (12, "u", "a" * 100, "s"), (13, "u", "b" * 99, "s"), (14, "u", "b" * 99, "s"),
    ]


def expected(rows):
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        again = len(payload) >= 100 and page != min(same)
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out)


def test_archives_give_back_every_payload(spark):
    frame = spark.createDataFrame(captures(), "page_id long, url string, html string, again string")
    assert sorted(map(tuple, warc.archived(frame.repartition(3)).collect())) == expected(captures())


def test_archives_of_repeated_rows_and_of_nothing(spark):
    rows = [(5, "u", "q" * 200), (5, "u", "q" * 200), (8, "u", "q" * 200), (None, "u", "w" * 200)]
    got = [tuple(r) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted((r[0] or -1, r[3], r[4]) for r in got) == [(-1, "response", None), (5, "response", None), (5, "response", None), (8, "revisit", 5)]
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _foreign():
    record = lambda kind, own, block, *more: ("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", *more, f"Content-Length: {len(block)}", "", ""]) + block + "\r\n\r\n").encode()
    http = "Content-Type: application/http; msgtype=response"
    return [
        record("warcinfo", "<w>", "software: x"),
        record("response", "<r1>", "HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody one", http),
        record("request", "<q1>", "GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r1>"),
        record("metadata", "<m1>", "a: b\r\n", "WARC-Concurrent-To: <q1>", "Content-Type: application/warc-fields"),
        record("metadata", "<m2>", "a: b\r\n", "WARC-Concurrent-To: <r1>"),
        record("response", "<r2>", "HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Concurrent-To: <q2>"),
        record("request", "<q2>", "GET / HTTP/1.1\r\n\r\n"),
        record("response", "<r3>", "no http at all"),
        record("request", "<q9>", "GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <gone>"),
    ]


@pytest.mark.parametrize("packing", ["plain", "members", "whole"])
def test_assembly_of_foreign_archives(spark, tmp_path, packing):
    records = _foreign()
    data = {"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "whole": gzip.compress(b"".join(records))}[packing]
    (tmp_path / "x.warc").write_bytes(data)
    got = {r["response"]["record_id"]: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>"}
    assert got["<r1>"]["request"]["record_id"] == "<q1>" and sorted(m["record_id"] for m in got["<r1>"]["metadata"]) == ["<m1>", "<m2>"]
    assert got["<r2>"]["request"]["record_id"] == "<q2>" and got["<r2>"]["metadata"] == [] and got["<r3>"]["request"] is None
    assert got["<r1>"]["response"]["payload_digest"] == hashlib.sha256(b"body one").hexdigest() and got["<r2>"]["response"]["payload_bytes"] == 0


def test_broken_records_raise():
    for bad in (b"junk\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab", b"WARC/1.1\r\nContent-Length: 9\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


# ---- licenses ----


def test_alignment_is_increasing_and_finds_edits():
    rng = random.Random(4)
    template = words_of(TEMPLATES["mit"].encode())
    for _ in range(40):
        noise = [b"w%d" % rng.randrange(50) for _ in range(rng.randrange(300))]
        copy = [w for w in template if rng.random() > 0.1]
        text = noise + copy + noise
        pairs = align(text, template)
        assert all(text[a] == template[b] for a, b in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) >= 0.9 * len(copy)


def test_licenses_against_plain_search(spark):
    words = "lorem the of license to and under " * 40
    rows = [(k, f"{words} {text} {words}", "x") for k, text in enumerate(TEMPLATES.values())]
    rows += [(50, None, "x"), (51, "", "x"), (52, words * 30, "x"), (None, TEMPLATES["mit"].upper(), "x")]
    rows += [(53, (TEMPLATES["mit-notice"] + "\n") * 3, "x"), (54, "word " * 30_000 + TEMPLATES["isc"], "x"), (55, "All your rights are ours", "x")]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert len(got) == len(rows)
    for k, (name, text) in enumerate(TEMPLATES.items()):
        hit = next(h for h in got[k]["hits"] if h["license"] == name)
        assert hit["coverage"] == 1.0 and hit["last_word"] - hit["first_word"] + 1 == len(words_of(text.encode()))
    assert [got[k]["license"] for k in (50, 51, 52, 55)] == [None] * 4 and got[50]["n_words"] == 0
    assert got[None]["license"] == "mit" and got[53]["license"] == "mit-notice" and got[54]["license"] == "isc"
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_notices_in_texts_that_begin_or_end_with_a_template_word(spark):
    rows, names = [], list(TEMPLATES)
    for k, name in enumerate(names):
        words = words_of(TEMPLATES[name].encode())
        first, last = words[0].decode(), words[-1].decode()
        twice = f"report tells {TEMPLATES[name]} between them {TEMPLATES[name]} and so on"
        rows += [(10 * k, f"{first} {twice}"), (10 * k + 1, f"{twice} {last}"), (10 * k + 2, f"{first} {twice} {last}")]
        rows += [(10 * k + 3, f"{first} report tells {TEMPLATES[name]} and so on {last}")]
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        name = names[r["doc_id"] // 10]
        assert [h["coverage"] for h in r["hits"] if h["license"] == name] == [1.0], (name, r["doc_id"])


# ---- classifiers ----


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(1, 256, 20)), None) for _ in range(600)]
    y = [int(3 in at) for at, _ in rows]
    rows = [(np.concatenate([[0], at]), np.ones(len(at) + 1)) for at, _ in rows]
    w, loose = (Ftrl(8, l1=l1).fit(rows, y, 5).weights() for l1 in (4.0, 0.0))
    assert np.argmax(w) == 3 and (w == 0).sum() > 2 * (loose == 0).sum()
    assert np.mean([(sigmoid(w[at] @ x) >= 0.5) == label for (at, x), label in zip(rows, y, strict=True)]) > 0.97


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    fire = lambda a, b: np.where(y, rng.random(3000) < a, rng.random(3000) < b)
    good, fair = fire(0.8, 0.01), fire(0.6, 0.05)
    votes = np.column_stack([good, fair, fair, fair])
    votes = np.column_stack([votes, ~votes.any(axis=1)])
    model = fit_label_model(votes)
    assert model.discount[0] > 1.5 * model.discount[1:4].max()
    assert ((model.posterior(votes.astype(float)) >= 0.5) == y).mean() > 0.88


def accuracy(spark, sf, scores, column):
    known = scores.join(table(spark, sf, "labels").select("doc_id", column), "doc_id").where("held_out")
    return known.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_quality_on_held_out_rows(spark, sf):
    scores = quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).cache()
    assert scores.count() == table(spark, sf, "documents").count()
    assert scores.where("score < 0 or score > 1 or (score >= 0.3) <> (predicted = 1)").count() == 0
    assert scores.where(F.col("held_out") != (crc_bucket() == 0)).count() == 0
    assert accuracy(spark, sf, scores, "quality") >= 0.97


def test_toxicity_on_held_out_rows(spark, sf):
    scores = toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert accuracy(spark, sf, scores, "toxic") >= 0.95


@pytest.mark.parametrize("scores, column, alone", [(quality_scores, "quality", 1.0), (toxicity_scores, "toxic", 0.0)])
def test_classifiers_on_odd_rows(spark, scores, column, alone):
    docs = [(k, "bad!! " * 30 if k % 2 else f"fine words number {k} here", "x") for k in range(40)]
    docs += [(None, "bad!! bad!!", "x"), (100, None, "x"), (101, "", "x"), (102, "fine " * 100_000, "x"), (1, "bad!! " * 30, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = [(k, (k % 2) ^ (column == "quality")) for k in range(40)] + [(None, 1), (3, None), (999, 1), (5, 7)]
    marks = spark.createDataFrame(labels, f"doc_id long, {column} int")
    got = {(r["doc_id"], k): r for k, r in enumerate(scores(frame, marks).collect())}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got.values())
    by = {key[0]: r for key, r in got.items()}
    bad = (by[7]["predicted"], by[6]["predicted"])
    assert bad == ((0, 1) if column == "quality" else (1, 0))
    assert by[100]["score"] == by[101]["score"] and by[None]["held_out"] is False
    blank = scores(frame, marks.where("false")).select("score").distinct().collect()
    assert [r["score"] for r in blank] == [alone]
    assert scores(frame.where("false"), marks).count() == 0


def test_lexicon_of_ones_own(spark):
    docs = spark.createDataFrame([(k, "you Grobian go" if k % 3 == 0 else "nice day today") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels, lexicon=["grobian"]).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got)


def test_samples_leave_out_held_out_rows(spark, sf):
    sample = quality.labelled_sample(table(spark, sf, "documents"), table(spark, sf, "labels"), "quality", 50)
    assert sample.count() == 50 and sample.where(crc_bucket() == 0).count() == 0
    assert toxicity.SAMPLE > 0


# ---- urls ----

URLS = [
    "http://www.Example.COM/en/x", "https://example.com/en/", "http://m.example.com/en/1?x=/es/", "http://example.com", "http://example.com/de/",
    "http://notexample.com/en/", "ftp://a.net/es/q#f", "http://net/fr/", "http://a.net/frx", "http://a.net?/fr/", "http://a.b.c.net/fr/1",
    "//x.net/es/", "", None, "x://", "http://.com/", "http://a..com/", "http://ÀB.com/É", "http://com./", "a://b://net/es/", "http://" + "a." * 5000 + "net/es/" + "p" * 50_000,
]


def test_urls_against_every_rule(spark):
    rows = [(k, u, "h") for k, u in enumerate(URLS * 2)] + [(None, URLS[0], "h")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[r["page_id"] % len(URLS)] if r["page_id"] is not None else URLS[0]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute.judge(url, [(v, h, p) for v, h, p in RULES])
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, x string"), []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 37 == 0).cast("int").alias("listed"))
    levels = url_cascade.build(universe)
    hashed = universe.select("listed", *url_cascade._hashes("key")).toPandas()
    found = url_cascade.listed(levels, hashed["h1"].to_numpy().view(np.uint64), hashed["h2"].to_numpy().view(np.uint64))
    assert (found == (hashed["listed"] == 1)).all() and len(levels) > 2
    assert url_cascade.build(universe.where("listed = 0")) == []


# ---- pages ----

BODY = "<p>The first paragraph of the story is long enough to count.</p><p>A second one, with <a href=x>a link</a> in&nbsp;it &amp; more<br>words.</p><p>Third and last paragraph here.</p>"
TEXT = "The first paragraph of the story is long enough to count. A second one, with a link in it & more words. Third and last paragraph here."
PAGES = [
    (f"<html><body><nav><a href=1>Home</a></nav><article><h1>Title</h1>{BODY}</article><footer>Copyright</footer></body></html>", "Title " + TEXT),
    (f"<body><div class='menu'><a>One</a><a>Two</a></div><div id=content>{BODY}</div><div class=sidebar>Side words that are many and long</div>", TEXT),
    (f"<header>Site</header><main>{BODY}<div class='comments'><p>I do not agree at all with this.</p></div><form><p>Subscribe now</p></form></main>", TEXT),
    (f"<article>{BODY}<ul><li><a>Read also</a><li><a>More here</a><li><a>And this</a></ul><aside>Notice</aside><div class='ad'>Buy</div></article>", TEXT),
    (f"<div><a>x</a> <a>y</a> <a>z</a></div><div><div>{BODY}</div></div><div>(c) 2020 some owner</div>", TEXT),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>one</p>\n<p>two  &lt;b&gt;\t three</p><noscript>no</noscript>", "one two <b> three"),
    ("<article><p>cut off here</p><p>and th", "cut off here and th"), ("<article><p>cut off</p><di", "cut off"), ("<article>a < b and c > d</article>", "a < b and c > d"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>t<dd>d</dl></article>", "a b c t d"),
    ("<ARTICLE>x<B>y</B>z <I>w</I></ARTICLE>", "xyz w"), ("", ""), (None, ""), ("<nav>only</nav>", ""), ("plain words", "plain words"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


LAYOUTS = ["site-content has-sidebar", "no-sidebar", "comments-open", "modal-open", "with-nav", "content-with-sidebar", "sidebar-layout", "widget"]


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("inner", [f"<article>{BODY}</article>", f"<main>{BODY}</main>", BODY])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_layout_wrappers_keep_the_article(name, inner, attribute):
    furniture = "<div class='main-nav'><p>Pick</p></div><div id=comments><article><p>I disagree.</p></article></div><div class='site-footer'>Imprint</div>"
    rest = "<div class='sidebar-left'>Side words</div>" + (furniture if inner != BODY else furniture.replace("article", "section"))
    assert main_text(f"<body><div {attribute}='{name}'>{inner}{rest}</div></body>") == TEXT


def test_extraction_keeps_rows(spark):
    rows = [(k, "u", page, "t") for k, (page, _) in enumerate(PAGES)] + [(None, None, "<p>é😀</p>", "t")] * 2
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == ("é😀" if r["page_id"] is None else PAGES[r["page_id"]][1]) and r["n_chars"] == len(r["text"])
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_of_the_generated_pages(spark, sf):
    import html
    import re

    for r in table(spark, sf, "pages").limit(100).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        text = re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")
        assert main_text(r["html"]) == " ".join(html.unescape(text).split())


# ---- mixtures ----


def mixed(spark, rows, **options):
    return mixing.poisson_mix(spark.createDataFrame(rows, "doc_id long, text string, source string, copy string, mix_key int"), **options)


def test_mixture_reaches_its_weights(spark):
    rows = [(k, "t", "a" if k < 3000 else "b" if k < 3900 else None, "x", 1) for k in range(4000)]
    got = mixed(spark, rows, weights={"a": 1.0, "b": 2.0, None: 1.0}, total=8000).collect()
    counts = Counter(r["source"] for r in got)
    for source, goal in (("a", 2000), ("b", 4000), (None, 2000)):
        assert abs(counts[source] - goal) < 5 * goal**0.5
    copies = Counter(Counter(r["doc_id"] for r in got if r["source"] == "a").values())
    assert abs(copies[1] / 3000 - 2 / 3 * np.exp(-2 / 3)) < 0.05
    assert all(sorted(r["copy"] for r in got if r["doc_id"] == d) == list(range(1, n + 1)) for d, n in list(Counter(r["doc_id"] for r in got).items())[:20])


def test_mixture_of_odd_rows(spark):
    rows = [(1, None, "a", "x", 1), (None, "t", "a", "x", 1), (None, None, None, "x", 1), (2, "", "b", "x", 1), (2, "", "b", "x", 1)]
    got = mixed(spark, rows, total=400)
    assert got.columns == ["doc_id", "text", "source", "mix_key", "copy"]
    twice = Counter(r["copy"] for r in got.where("doc_id = 2").collect())
    assert twice and set(twice.values()) == {2}
    assert mixed(spark, rows, weights={"a": 1.0}).where("source = 'b' or source is null").count() == 0
    assert mixed(spark, rows, weights={"zz": 1.0}).count() == 0 and mixed(spark, [], total=5).count() == 0


def test_mixture_by_shuffle_is_the_same(spark, monkeypatch):
    rows = [(k, "t", f"s{k % 7}", "x", 1) for k in range(300)]
    one = sorted(map(tuple, mixed(spark, rows).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixed(spark, rows).collect()), key=str) == one


def test_mixture_is_native(spark):
    plan = mixed(spark, [(1, "t", "a", "x", 1)])._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Cartesian" not in plan
