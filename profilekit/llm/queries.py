"""One registered query for each operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilekit.catalog.registry import table
from profilekit.llm import (
    decontaminate, divergence, licences, linededup, neighbours, packing, pii, quality, sharding, simhash, streamdedup, toxicity, whitening
)
from profilekit.runtime import shared_folder

SHARDS = 24

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def predicted(df: DataFrame, held_out, *more: str) -> DataFrame:
    """The columns that classifiers return: a label is predicted from a score of 0.7."""
    return df.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), *more,
    )


@query
def op1_quality_votes(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trained = quality.trained_rows()
    voters = quality.fit(docs, labels, trained=trained)
    return predicted(quality.score(docs.select("doc_id", "text"), voters), ~trained)


@query
def op5_toxicity_grammar(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trained = toxicity.trained_rows()
    grammar = toxicity.learn(docs, labels, trained=trained)
    return predicted(toxicity.score(docs.select("doc_id", "text"), grammar), ~trained, "toxic_clauses", "toxic_words")


@query
def op4_simhash_variants(spark, sf_dir):
    return simhash.SimHash().assign(table(spark, sf_dir, "documents"))


@query
def op3_shard_slots(spark, sf_dir):
    slotted = sharding.with_slots(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    slot_map = sharding.SlotMap.first(slotted, SHARDS)
    history = f"{shared_folder(spark)}/slot-map-{uuid.uuid4()}"
    slot_map.write(spark, history)
    placed = sharding.place(slotted, sharding.SlotMap.read(spark, history, slot_map.version), ["doc_id", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )


@query
def op6_collision_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query
def op8_spaced_seeds(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.mark(docs.select("doc_id", "text"), benchmark).drop("text")


@query
def op9_site_lines(spark, sf_dir):
    docs = linededup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(
        "doc_id", "source", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), "text"
    )


BARE = "trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
ORACLES["op9_site_lines"] = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(DISTINCT text) AS n_site FROM pages GROUP BY source),
held AS (
  SELECT source, line, count(DISTINCT text) AS n_pages
  FROM (SELECT source, text, unnest(list_distinct(list_transform(lines, lambda x: {BARE}))) AS line FROM pages)
  WHERE length(line) > 0 GROUP BY source, line),
boilerplate AS (
  SELECT source, list(line) AS bad FROM held JOIN totals USING (source)
  WHERE n_pages >= {linededup.LEAST_PAGES} AND n_pages / n_site > {linededup.MOST_RATIO} GROUP BY source),
kept AS (
  SELECT p.*, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, {BARE}) OR {BARE} = '') END AS rest
  FROM pages p LEFT JOIN boilerplate USING (source))
SELECT doc_id, source, len(lines)::BIGINT AS n_lines, (len(lines) - len(rest))::BIGINT AS n_dropped,
  CASE WHEN len(lines) = len(rest) THEN text ELSE array_to_string(rest, chr(10)) END AS text
FROM kept"""


@query
def op2_information_pii(spark, sf_dir):
    docs = pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


@query
def op10_licence_rules(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


@query
def op11_stream_dedup(spark, sf_dir):
    classes = streamdedup.dedup(spark, f"{sf_dir}/documents.parquet", f"{shared_folder(spark)}/dedup-{uuid.uuid4()}")
    return classes.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op11_stream_dedup"] = """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS l FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY t ORDER BY l DESC, doc_id)"""


@query
def op12_weighted_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{divergence.TERM}') AS terms
  FROM documents),
tokens AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= {divergence.LEAST_DOCS}),
languages AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, term, total, coalesce(n, 0) AS n FROM groups g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT c.lang, c.source, term, n,
    1 + ({divergence.UNIT}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY c.lang, c.source) + v) AS p,
    1 + ({divergence.UNIT}::HUGEINT * (total + 1)) // (n_lang + v) AS q
  FROM cells c JOIN languages USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
parts AS (
  SELECT * FROM all_pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}"""
