"""The pipeline's stages and result against plain definitions, over whole small tables."""

import hashlib
import math

import pytest

import corpus_pipeline
from lattica.llm import queries
from lattica.llm.common import table
from lattica.llm.quality import quality_scores
from lattica.llm.toxicity import toxicity_scores

from . import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of each stage, as rows."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SMALL, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{k}")
        done = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, done))
        docs = done
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_columns(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [after.columns for _, after in stages] == [columns] * 4 + [[*columns, "copy"]]


def test_classifiers_decide(spark, stages):
    labels = table(spark, SMALL, "labels")
    for (before, after), scores, keep in ((stages[0], quality_scores, 1), (stages[1], toxicity_scores, 0)):
        assert ids(after) == ids(scores(before, labels).where(f"predicted = {keep}"))


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    found = brute.near_duplicates({r["doc_id"]: r["text"] for r in before.collect()})
    assert ids(after) == sorted(d for d, (_, component) in found.items() if d == component)


def test_contaminated_documents_go(spark, stages):
    before, after = stages[3]
    windows = set()
    for r in table(spark, SMALL, "benchmark").collect():
        words = brute.benchmark_words(r["text"])
        n = min(10, len(words))
        windows |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1 if n else 0)}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = brute.benchmark_words(text)
        return not any(tuple(words[k : k + n]) in windows for n in sizes for k in range(len(words) - n + 1))

    assert ids(after) == sorted(r["doc_id"] for r in before.collect() if clean(r["text"]))
    assert len(ids(after)) < len(ids(before))


def test_copies_follow_the_poisson_distribution(stages):
    before, after = stages[4]
    rows = before.collect()
    counts = {}
    for r in rows:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    weight = sum(math.sqrt(n) for n in counts.values())
    expected = []
    for r in rows:
        n = counts[r["source"]]
        rate = math.sqrt(n) / weight * len(rows) / n
        u = int(hashlib.md5(f"1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        reached, copies = math.exp(-rate), 0
        while reached <= u:
            copies += 1
            reached += math.exp(-rate + copies * math.log(rate) - math.lgamma(copies + 1))
        expected += [(r["doc_id"], k) for k in range(1, copies + 1)]
    assert sorted((r["doc_id"], r["copy"]) for r in after.collect()) == sorted(expected)


def test_run_gives_the_last_stage(spark, stages):
    done = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, done.collect()), key=str) == sorted(map(tuple, stages[4][1].collect()), key=str)


def test_odd_rows_pass(spark, tmp_path):
    docs = table(spark, SMALL, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9, "", "en", None, 0), (10**9 + 1, "w " * 50_000, "en", "s", 1)], docs.schema)
    docs = docs.union(odd).union(docs.limit(5))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k != 2 or len(ids(docs.where("doc_id is not null"))) == len(set(ids(docs.where("doc_id is not null"))))


def test_empty_documents(spark, tmp_path):
    docs = table(spark, SMALL, "documents").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_return_a_row_per_row(spark, name):
    done = queries.queries()[name](spark, SMALL)
    of = {"op1": "pages", "op4": "pages", "op10": "pages", "op7": "embeddings"}.get(name.split("_")[0], "documents")
    if not name.startswith("op8_"):
        assert done.count() == table(spark, SMALL, of).count()


def test_near_dedup_holds_pairs_to_four_fifths(spark):
    words = [f"w{k}" for k in range(94)]  # 90 shingles
    near = {n: " ".join(words[:-n] + [f"x{n}y{k}" for k in range(n)]) for n in (9, 12)}  # 81 of 99 shared, 78 of 102
    docs = {1: " ".join(words), 2: near[9], 3: near[12]}
    sets = {d: brute.shingles(t) for d, t in docs.items()}
    assert 0.80 <= len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.85 and len(sets[1] & sets[3]) / len(sets[1] | sets[3]) < 0.80
    rows = [(d, t, "en", "s", len(t)) for d, t in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = brute.near_duplicates(docs, percent=80)
    assert ids(corpus_pipeline.near_dedup(spark, frame, SMALL)) == sorted(d for d, (_, component) in expected.items() if d == component) == [1, 3]
