"""Ids beyond 2^53 beside nulls, both sides of each bound, clashing names, very long pages, and brute-force versions."""

import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import html_extract, license_scan, mixing, quality, queries, toxicity, url_cascade, warc
from lattica.llm.bench_decontam import contamination, without_spans
from lattica.llm.ftrl import Ftrl, sigmoid
from lattica.llm.minhash_dedup import near_duplicates

from . import brute

BIG = 2**53
SMALL = "/root/testdata/sf0.001"
IDS = [BIG + 1, None, BIG + 2]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, f"some words of text number {k} that differ", "en", "s", 9) for k, i in enumerate(IDS)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).cache()


@pytest.mark.parametrize("name", ["op2", "op3", "op5", "op6", "op8", "op9"])
def test_large_ids_of_documents(spark, documents, name):
    labels, tests = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    run = {
        "op2": lambda: license_scan.scan_licenses(documents), "op3": lambda: quality.quality_scores(documents, labels), "op5": lambda: toxicity.toxicity_scores(documents, labels),
        "op6": lambda: near_duplicates(documents), "op8": lambda: mixing.poisson_mix(documents, total=3000).dropDuplicates(["doc_id"]), "op9": lambda: contamination(documents, tests),
    }
    rows = run[name]().collect()
    assert {r["doc_id"] for r in rows} == set(IDS) and len(rows) == 3
    if name == "op6":
        assert {r["component_id"] for r in rows} == set(IDS)


def test_large_ids_of_pages(spark):
    pages = spark.createDataFrame([(i, f"http://a{k}.net/es/", "<p>" + "word " * 30 + f"{k}</p>") for k, i in enumerate(IDS)], "page_id long, url string, html string").coalesce(1)
    for found in (url_cascade.judge_urls(pages, url_cascade.RULES), html_extract.extract_text(pages), warc.archived(pages)):
        assert {r["page_id"] for r in found.collect()} == set(IDS)


def test_spans_do_not_depend_on_parts(spark):
    words = [f"w{k}" for k in range(80)]
    docs = spark.createDataFrame([(1, " ".join(words), BIG + 1), (2, None, None)], "doc_id long, text string, lattica long")
    tests = spark.createDataFrame([(1, " ".join(words[20:60]))], "item_id long, text string")
    for most in (3, 5, 10**6):
        got = {r["doc_id"]: r for r in without_spans(docs, tests, most=most).collect()}
        assert got[1]["text"].split() == words[:20] + words[60:] and got[1]["lattica"] == BIG + 1 and got[2]["text"] is None


@pytest.mark.parametrize("most", [200, 1 << 28])
def test_lists_longer_than_a_level(spark, monkeypatch, most):
    monkeypatch.setattr(url_cascade, "MOST_BITS", most)
    rules = [("block" if k % 3 else "allow", f"h{k}.net", "/" if k % 2 else "/a") for k in range(90)]
    urls = [(k, f"http://x.h{k}.net/{'a' * (k % 4)}") for k in range(120)]
    got = url_cascade.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {k: brute.judge(u, rules) for k, u in urls}


@pytest.mark.parametrize("most", [0, 8 << 20])
def test_mixtures_beside_any_names(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([(k, f"t{k}", "ab"[k % 2], k, k, k, k) for k in range(200)], "doc_id long, text string, source string, lattica_place int, lattica_count int, mix_key int, copy int")
    got = mixing.poisson_mix(docs, total=400)
    assert got.columns == ["doc_id", "text", "source", "lattica_place", "lattica_count", "mix_key", "copy"]
    rows = got.collect()
    assert all(r["lattica_place"] == r["lattica_count"] == r["mix_key"] == r["doc_id"] for r in rows)
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) > 200


def test_pipeline_judges_rows(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(None, text), (None, text), (7, text), (7, "other words than those of the row beside this one here"), (7, text), (3, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(7, text), (7, rows[3][1]), (3, ""), (0, ""), (0, "")])
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    mixed = docs.limit(1).union(spark.createDataFrame([(None, item, "en", "s", 1), (7, item, "en", "s", 1), (7, text, "en", "s", 1)], docs.schema))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.decontaminate(spark, mixed, SMALL).collect()) == [(0, text), (7, text)]


def test_pages_are_read_in_linear_time():
    for page in ("<a " * 350_000, "<p title='" * 100_000, "<div>" * 200_000 + "x", "<b>" * 100_000 + "<tr></tr>" * 60_000):
        began = time.thread_time()
        html_extract.main_text(page)
        assert time.thread_time() - began < 10


def test_densities_choose_the_article(monkeypatch):
    pages = pd.read_parquet(f"{SMALL}/pages.parquet")["html"]
    texts = [html_extract.main_text(p) for p in pages]
    assert [html_extract.main_text(re.sub("<(/?)article", r"<\1div", p)) for p in pages] == texts
    for source in pages[:20]:
        page = html_extract.Page(source)
        in_link = [False] * len(page.tags)
        for k in range(1, len(page.tags)):
            in_link[k] = page.tags[k] == "a" or in_link[page.parents[k]]
        pieces = [(n, s, s * in_link[n]) for n, _, t in page.texts for s in [sum(map(len, html_extract.html.unescape(t).split()))]]
        assert page.selected() == brute.main_node(page.tags, page.parents, pieces, page.furniture)
    monkeypatch.setattr(html_extract.Page, "densities", lambda self: ([0.0] * len(self.tags), [0.0] * len(self.tags)))
    assert [html_extract.main_text(p) for p in pages] != texts


def test_alignments_against_common_subsequences():
    """An alignment is a common subsequence, and where words are unique the longest one."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        template = [b"t%d" % k for k in range(30)]
        text = [w for w in template if rng.random() < 0.8]
        for at in sorted(rng.integers(0, len(text) + 1, 12), reverse=True):
            text.insert(at, b"x%d" % rng.integers(0, 9))
        if rng.random() < 0.5:
            a, b = sorted(rng.integers(0, len(text), 2))
            text[a], text[b] = text[b], text[a]
        pairs = license_scan.align(text, template)
        assert all(text[p] == template[q] for p, q in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == brute.common_words(text, template)


def test_quality_scores_against_plain_regression():
    texts = [f"good plain words number {k % 7} here".encode() for k in range(12)] + [f"bad {'#' * (k % 3 + 1)} junk {k % 5} junk".encode() for k in range(12)]
    rows, labels = list(quality._vectors(texts)), [1] * 12 + [0] * 12
    order = [k for epoch in [np.random.default_rng(5)] for _ in range(3) for k in epoch.permutation(len(rows))]
    model = Ftrl(quality.BITS, alpha=0.5, l1=0.02, l2=0.1).fit(rows, labels, 3)
    got = [float(sigmoid(model.weights(at) @ x)) for at, x in rows]
    assert np.allclose(got, brute.ftrl_score(rows, labels, rows, quality.BITS, order, 0.5, 0.02, 0.1))


def test_toxicity_scores_against_the_sum_of_weights():
    found = [(b"\t".join(sorted(toxicity._terms(f"text {k} {'you idiot scum' if k % 3 == 0 else 'of usual words'} {k % 4}".encode()))), int(k % 3 == 0)) for k in range(90)]
    bias, weights = toxicity.train(found)
    for text in (b"an idiot", b"usual words of text", b"", b"scum " * 9):
        score = 1 / (1 + np.exp(-bias - sum(w for t, w in weights.items() if t in toxicity._terms(text))))
        assert toxicity.score([text], (bias, weights)) == pytest.approx([score])
    assert toxicity.score([b"you idiot scum"], (bias, weights))[0] > 0.5 > toxicity.score([b"of usual words"], (bias, weights))[0]


def test_queries_read_whole_tables():
    assert len(queries.queries()) == 10
