import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import bench_decontam, embedding_dedup, minhash_dedup
from lattica.llm.bench_decontam import contamination, without_spans
from lattica.llm.components import components
from lattica.llm.embedding_dedup import near_vectors
from lattica.llm.minhash_dedup import near_duplicates

from . import brute


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs_chains_and_stars(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    links += [(100 + k, 101 + k) for k in range(20)] + [(200, 201 + k) for k in range(30)] + [(7, 7), (3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 1)], "u long, v long")).collect()}
    assert got == {n: c for n, c in brute.groups({n for l in links for n in l}, links).items() if any(n in l and l[0] != l[1] for l in links)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus():
    """Copies, near copies on both sides of the threshold, chains, a common line, and odd texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs, line = {}, " ".join(word() for _ in range(12))
    for group in range(6):
        words = [word() for _ in range(90)]
        for copy in range(9):
            own = list(words)
            for _ in range(copy // 2):
                own[rng.randrange(90)] = word()
            docs[len(docs) * 3] = line + "\n" + " ".join(own)
    chain = [word() for _ in range(80)]
    for _ in range(10):
        docs[len(docs) * 3] = " ".join(chain)
        chain[rng.randrange(80)] = word()
    odd = ["", None, "  \t\n ", "one", "ONE", "one two three", "One  TWO\tthree", "Été a b c d e", "été a b c d e", "x " * 9000, "x " * 8000]
    for text in odd:
        docs[len(docs) * 3 + 1] = text
    docs[2] = docs[0]
    docs[10**12] = docs[0]
    return docs


@pytest.mark.parametrize("block", [4, 384])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in docs.items()], "doc_id long, text string, node string, kept int, set_key string")
    got = near_duplicates(frame.repartition(5)).collect()
    expected = brute.near_duplicates(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_repeated_rows_and_rows_without_id(spark):
    text, other = "a b c d e f g h", "q r s t u v w"
    rows = [(5, text), (5, text), (None, text), (3, text), (9, None), (8, other), (8, text)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [
        (-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (8, 3, False), (8, 3, False), (9, 9, True)
    ]


def test_near_duplicates_of_rows_that_share_an_id_but_not_a_text(spark):
    rows, expected = [], []
    for k in range(10, 130, 10):
        text = [f"t{k}w{n}" for n in range(120)]
        own = [(k, " ".join(text)), (k, f"other {k} and not the same text"), (k, "")]
        rows += (own if k % 20 else own[::-1]) + [(k + 1, " ".join(text[:-1] + ["end"]))]
        expected += [(k, k, True)] * 3 + [(k + 1, k, False)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == expected


def test_near_duplicates_of_nothing(spark):
    empty = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=8)
            for _ in range(6):
                rows.append([(centre + rng.normal(size=8) * rng.choice([0, 0.05, 0.3])).astype("f4").tolist(), label])
    rows += [[None, 0], [[], 0], [[0.0] * 8, 0], [[float("nan")] + [1.0] * 7, 0], [[None] + [1.0] * 7, 0], [[float("inf")] * 8, 0], [[1.0, 2.0], 0], [[2.0, 4.0], 0]]
    return [(7 * k, v, label) for k, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("cell", [4, 16, 1024])
def test_near_vectors_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], "vec_id long, embedding array<float>, label int, node double")
    got = {r["vec_id"]: r for r in near_vectors(frame.repartition(4), probes=64).collect()}
    expected = brute.near_vectors(rows)
    assert len(got) == len(rows)
    for k, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (*expected[k], k == expected[k][1])


def test_recall_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 32)
    rng = np.random.default_rng(9)
    rows = [(k, (v + rng.normal(size=16) * 0.04).tolist(), 1) for k, v in enumerate(np.repeat(rng.normal(size=(300, 16)), 3, axis=0))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), probes=4)
    found, true = sum(r["n_links"] for r in got.collect()), sum(n for n, _ in brute.near_vectors(rows).values())
    assert 0.97 * true <= found <= true


def test_vectors_that_repeat_or_lack_an_id(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(4, v, 1), (4, v, 1), (None, v, 1), (2, v, 1), (7, w, 1), (7, v, 2)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in got) == [
        (-1, 3, -1, True), (2, 3, 2, True), (4, 3, 2, False), (4, 3, 2, False), (7, 0, 7, True), (7, 0, 7, True)
    ]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def benchmark():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdxyzé") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 3, 9, 10, 14, 30])))) for k in range(25)]
    items += [(25, items[-1][1]), (26, None), (27, "! ?"), (28, "Lonely")]
    docs = {}
    for k in range(60):
        own = [word() for _ in range(rng.choice([0, 5, 40, 300]))]
        for _ in range(k % 4):
            piece = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(own) + 1)
            own[at:at] = [w.upper() if w.isascii() else w for w in piece[rng.choice([0, 0, 2]) :]]
        docs[k] = ", ".join(own[: len(own) // 2]) + "\n--" + " ".join(own[len(own) // 2 :])
    docs |= {100: None, 101: "", 102: "lonely " * 30, 103: "..."}
    return items, docs


@pytest.mark.parametrize("most", [15, 10**6])
def test_contamination_against_all_windows(spark, most):
    items, docs = benchmark()
    rows = [(k, t, "x") for k, t in docs.items()] + [(None, docs[3], "y"), (3, docs[3], "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_hit string")
    tests = spark.createDataFrame([(i, t, 1) for i, t in items] + [(None, "abc abc", 0)], "item_id long, text string, marks int")
    got = contamination(frame, tests, most=most).collect()
    assert len(got) == len(rows)
    for r in got:
        text = docs[r["doc_id"]] if r["doc_id"] is not None else docs[3]
        expected = brute.contamination(text, items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == expected
        assert r["contaminated"] == (expected[1] > 0)


def test_contamination_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in contamination(docs, none).collect()] == [(2, 0, 0)]
    assert contamination(docs.where("false"), none).count() == 0


def test_spans_are_cut(spark):
    items, docs = benchmark()
    frame = spark.createDataFrame([(k, t, "x", 2) for k, t in docs.items()], "doc_id long, text string, marks string, c1 int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in without_spans(frame, tests).collect()}
    assert got[100]["text"] is None and got[0]["marks"] == "x" and got[0]["c1"] == 2
    for k, text in docs.items():
        words, hit, _, _ = brute.contamination(text, items)
        assert len(brute.benchmark_words(got[k]["text"])) == words - hit
        assert hit or got[k]["text"] == text


def test_parts_cover_all_windows(spark):
    items, _ = benchmark()
    windows = bench_decontam.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    parts = list(bench_decontam._parts(windows, 20))
    assert sum(len(p.items) for p in parts) == windows.count() and len(parts) > 1
    assert windows.where(F.size("items") > 1).count() > 0
