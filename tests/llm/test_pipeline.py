"""The stages one by one against what they must keep, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from profilekit.llm import toxicity
from corpus_fixtures import documents, odd  # noqa: F401

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
RNG = random.Random(11)


def text(n=120):
    return " ".join("".join(RNG.choices("abcdefghijk", k=5)) for _ in range(n))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("own")).withColumn("contaminated", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, documents):
    docs = documents(text(), text() + " you are a worthless idiot " + text(), None, "")
    assert {r.doc_id for r in STAGE["toxicity"](spark, docs, SF).collect()} == {0, 2, 3}


def test_lines_go_and_lengths_follow(spark, documents):
    docs = documents(*[(i, f"{text(30)}\nMenu of the site") for i in range(40)], (99, text(), "t"))
    out = {r.doc_id: r for r in STAGE["line dedup"](spark, docs, SF).collect()}
    assert len(out) == 41 and all("Menu" not in r.text and r.n_chars == len(r.text) for r in out.values())


def test_stages_take_odd_rows(spark, odd):
    """Null, empty, very long and repeated texts and ids pass the filtering stages; near-copies keep one row of equal texts."""
    rows = odd.count()
    for name in ("toxicity", "line dedup", "benchmark"):
        out = STAGE[name](spark, odd, SF)
        assert out.columns == odd.columns and out.count() == rows, name
    kept = [r.text for r in STAGE["near-copies"](spark, odd, SF).collect()]
    assert kept.count("same text here") == 1 and {r.text for r in odd.collect() if len((r.text or "").split()) > 2} <= set(kept)
    pieces = STAGE["packing"](spark, odd, SF)
    assert pieces.where("piece = 0").count() == rows
    assert pieces.where("length > 2048 or length < 1").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_go(spark, documents, seed):
    rng = random.Random(seed)
    originals = [text(200).split() for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(originals)]
    for i, t in enumerate(originals):
        near = list(t)
        near[rng.randrange(200)] = "changed"
        rows.append((1000 + i, " ".join(near)))
    kept = {r.doc_id for r in STAGE["near-copies"](spark, documents(*rows, (2000, rows[0][1])), SF).collect()}
    assert kept == set(range(60))


def test_benchmark_text_goes(spark, documents):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    docs = documents(text(), text() + " " + item + " " + text(), None)
    assert {r.doc_id for r in STAGE["benchmark"](spark, docs, SF).collect()} == {0, 2}


def test_run_equals_the_stages_by_hand(spark):
    rows = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), trained=toxicity.trained_rows())
    clean = [r for r in docs.collect() if grammar.score(r.text or "", {}, set())[0] < corpus_pipeline.TOXIC]
    kept = spark.createDataFrame(clean, docs.schema)
    for name in ("line dedup", "near-copies", "benchmark"):
        kept = STAGE[name](spark, kept, SF)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    fill = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert fill[0] <= 2048 and fill[2] <= 1.1 * fill[1] / 2048 + 1
