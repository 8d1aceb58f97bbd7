"""Exact duplicates by stateful streaming.

Two streams, both of which continue where they stopped:

1. Documents become a log of ``(doc_id, length, digest, file, row)``. The text is read and hashed once; ``file`` and
   ``row`` locate its content.
2. The log updates keyed state on disk (RocksDB, saved to the shared folder) that never expires. For each digest it
   retains the number of rows, and the length, identifier and locator of the row that stays. Rows of one digest are
   combined before they are shuffled, so a text that fills a third of the table reaches the state as one row a task.

A digest that was seen before is a hit. The content of all its rows is fetched by locator and compared byte by byte; rows
that share a digest but not the bytes become classes of their own.

Texts are equal when they are identical after white space ``[\\x20\\x09-\\x0D]`` is deleted; null counts as empty. Of equal
texts the one with the most code points stays, then the smallest id, then the first locator, so that of repeated rows
exactly one stays. Null ids come after all others. Other columns of the input are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.runtime import hint_if_small, quoted

SPACE = " \t\n\x0b\x0c\r"
LOCATOR = ["file", "row"]
#: State on disk, saved as change logs. Its memory is bounded in each executor.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    # Space set aside in advance is several MB for each partition, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Most bytes of documents, and of their log, in one batch.
TEXT_BYTES, LOG_BYTES = 64 << 30, 16 << 30
#: The file source forgets files older than this among later ones; none may be forgotten.
NEVER = "36500d"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(files: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, file, row)`` of a table of Parquet files, streaming or not."""
    place = files.metadataColumn("_metadata")
    return files.select(
        F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"),
        place["file_path"].alias("file"), place["row_index"].alias("row"),
    )


def read_stream(spark: SparkSession, path: str, schema: T.StructType, most_bytes: int = TEXT_BYTES) -> DataFrame:
    """The Parquet files in the folder ``path`` as a stream of batches of at most ``most_bytes``."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(most_bytes)).option("maxFileAge", NEVER).parquet(path)


def as_folder(table: DataFrame, path: str) -> str:
    """``path``, or a pattern that only it matches if ``table`` is a single file, which streams take in no other way."""
    path, files = path.rstrip("/"), table.inputFiles()
    alone = len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rsplit("/", 1)[-1])
    return f"{path[:-1]}[{path[-1]}]" if alone else path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the queries started inside; the earlier ones come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class StreamDedup:
    """Keyed state, logs and checkpoints of one deduplicated corpus, all under ``folder``, which executors must share.

    ``digest`` maps a normalised text to a key. The result is the same for any digest; a poor one costs time.
    """

    def __init__(self, spark: SparkSession, folder: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.folder, self.digest = spark, folder, digest

    def run(self, stream: DataFrame) -> None:
        """Take in what is new in ``stream``, which is shaped as :func:`located` gives it."""
        text = F.coalesce("text", F.lit(""))
        log = stream.select("doc_id", F.length(text).alias("length"), self.digest(normalised(F.col("text"))).alias("digest"), *LOCATOR)
        self._until_done(log.writeStream.format("parquet").option("path", f"{self.folder}/log"), "log")
        rows = read_stream(self.spark, f"{self.folder}/log", log.schema, LOG_BYTES)
        kept = F.struct((-F.col("length")).alias("order"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR)
        state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(kept).alias("kept"))

        def write_hits(changed: DataFrame, batch: int) -> None:
            changed.where(F.col("n") > 1).write.mode("overwrite").parquet(f"{self.folder}/hits/batch={batch}")

        # The table of hits exists before the first batch, also for a stream without rows.
        none = self.spark.createDataFrame([], state.schema)
        none.write.mode("overwrite").parquet(f"{self.folder}/hits/batch=-1")
        with settings(self.spark, STATE_STORE):
            self._until_done(state.writeStream.outputMode("update").foreachBatch(write_hits), "state")

    def _until_done(self, writer, name: str) -> None:
        writer.option("checkpointLocation", f"{self.folder}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log")

    def hits(self) -> DataFrame:
        """The last state of every digest with more than one row."""
        hits = self.spark.read.parquet(f"{self.folder}/hits")
        last = hits.groupBy("digest").agg(F.max(F.struct("batch", "n", "kept")).alias("last"))
        return last.select("digest", "last.n", "last.kept")

    def result(self, content: DataFrame) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, digest`` for every row taken in.

        ``content`` holds the same rows as a batch table shaped as :func:`located` gives it.
        """
        path = f"{self.folder}/classes"
        self.hits().write.mode("overwrite").parquet(path)
        hits = self.spark.read.parquet(path)
        if hits.isEmpty():
            classes = hits
        else:
            classes = self._checked(hits, content)
        log = self.log()
        if "row_of_class" in classes.columns:
            joined = log.join(classes.withColumnRenamed("row_of_class", "row"), ["digest", *LOCATOR], "left")
        else:
            joined = log.join(hint_if_small(classes), "digest", "left")
        alone = F.col("n").isNull()
        return joined.select(
            "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (alone | ((F.col("file") == F.col("kept.file")) & (F.col("row") == F.col("kept.row")))).alias("kept"), "digest",
        )

    def _checked(self, hits: DataFrame, content: DataFrame) -> DataFrame:
        """The classes of ``hits`` after their full bytes were compared.

        One row per digest, ``(digest, n, kept)``, if no digest holds two texts. Else one for each row in a hit,
        ``(digest, file, row_of_class, n, kept)``.
        """
        rows = self.log().join(hint_if_small(hits.select("digest")), "digest", "left_semi")
        rows = rows.select("doc_id", "length", "digest", *LOCATOR)
        path = f"{self.folder}/hit-rows"
        rows.write.mode("overwrite").parquet(path)
        rows = hint_if_small(self.spark.read.parquet(path))
        texts = content.select(normalised(F.col("text")).alias("text"), *LOCATOR).join(rows, LOCATOR)
        # All texts of a digest are equal when the smallest is the largest; partial sums keep copies out of the shuffle.
        compared = texts.groupBy("digest").agg(F.count("*").alias("read"), (F.min("text") != F.max("text")).alias("differ"))
        compared = hits.join(compared, "digest", "left").where(F.col("differ") | F.col("read").isNull() | (F.col("read") != F.col("n")))
        path = f"{self.folder}/compared"
        compared.select("digest", "n", "read", "differ").write.mode("overwrite").parquet(path)
        compared = self.spark.read.parquet(path)
        changed = compared.where(F.col("read").isNull() | (F.col("read") != F.col("n"))).select("n", "read").head(1)
        if changed:
            raise RuntimeError(f"the content does not hold the rows that were taken in: {changed[0]['read']} of {changed[0]['n']} of a digest")
        if compared.isEmpty():
            return hits
        kept = F.struct((-F.col("length")).alias("order"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR)
        classes = texts.groupBy("digest", "text").agg(F.count("*").alias("n"), F.min(kept).alias("kept"))
        return texts.select("digest", "text", *LOCATOR).join(classes, ["digest", "text"]).select(
            "digest", "file", F.col("row").alias("row_of_class"), "n", "kept"
        )


def dedup(spark: SparkSession, path: str, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The exact duplicates of the Parquet table at ``path``: a stream over its files, then the classes of its rows."""
    table = spark.read.parquet(path)
    state = StreamDedup(spark, folder)
    state.run(located(read_stream(spark, as_folder(table, path), table.schema), doc_id, text))
    return state.result(located(table, doc_id, text))
