"""A corpus from documents: toxic ones go, then boilerplate lines, near-copies and benchmark text; the rest is packed.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``docs``; the last returns the pieces of the packed sequences. Stages are
tied to each other by Parquet tables in the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit.llm import decontaminate, linededup, packing, toxicity
from profilekit.llm.nearcopies import NearCopies
from profilekit.runtime import quoted, shared_folder

#: Score from which a document is toxic.
TOXIC = 0.7
#: Near-copies: sets of shingles of five words with a Jaccard similarity of 0.8 or more, verified on the sets.
NEAR_COPIES = NearCopies(words=5, least=0.8)


def beside(docs: DataFrame, operate) -> tuple[DataFrame, list]:
    """``operate(docs)`` and the expressions that give the columns of ``docs`` back from it.

    Operators replace input columns named like their results, so the input's
    columns but the text and those asked for are put aside in one struct.
    """
    names = ["doc_id", "source", "text"]
    rest = F.struct(F.lit(0).alias("no column"), *[F.col(quoted(c)) for c in docs.columns if c not in names]).alias("put aside")
    out = operate(docs.select(*[F.col(quoted(c)) for c in docs.columns if c in names], rest))
    return out, [F.col(quoted(c)) if c in names else F.col("put aside").getField(c).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the grammar scores below the threshold. It learns from the labelled rows of the whole table."""
    source, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.learn(source, labels, trained=toxicity.trained_rows())
    scored, columns = beside(docs, lambda d: toxicity.score(d, grammar))
    return scored.where(F.col("score") < TOXIC).select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` is counted anew where the text changed."""
    out, columns = beside(docs, linededup.drop_boilerplate)
    out = out.select("n_dropped", *columns)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one with the smallest id."""
    return NEAR_COPIES.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark text was found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked, columns = beside(docs, lambda d: decontaminate.mark(d, benchmark))
    return marked.where(~F.col("contaminated")).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("packing", pack),
]

#: The grammar, the fingerprints and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
