"""Streaming deduplication against a plain grouping of the normalised texts."""

import hashlib
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from profilekit.llm import streamdedup as s
from profilekit.llm.queries import QUERIES

from corpus_fixtures import ODD, documents, odd  # noqa: F401


def plain(rows):
    """Expected (doc_id, keep_id, group_size, sha256) in order; ids are unique or repeated in equal rows."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def got(result):
    rows = result.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("h")).collect()
    return sorted([tuple(r) for r in rows], key=repr)


def stored(df, folder, files=1):
    path = str(folder / "docs.parquet")
    df.repartition(files).write.parquet(path)
    return path


def test_odd_rows(spark, odd, tmp_path):  # noqa: F811
    path = stored(odd, tmp_path, 3)
    result = s.dedup(spark, path, str(tmp_path / "state")).cache()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert len(rows) == len(ODD) + 2
    assert got(result) == plain(rows)
    # One row of each class stays, also where ids or whole rows are repeated.
    assert result.where("kept").count() == len({x[3] for x in plain(rows)})
    assert result.where("kept AND NOT (doc_id <=> keep_id)").isEmpty()


def test_repeated_rows_ties_and_white_space(spark, documents, tmp_path):  # noqa: F811
    docs = documents((5, "a b"), (5, "a b"), (3, "a b"), (9, "a\u000b b"), (9, "ab "), (1, "a b"), (2, "A B"), (7, "a\u0085b"))
    result = s.dedup(spark, stored(docs, tmp_path), str(tmp_path / "state")).cache()
    assert got(result) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result.where("kept").count() == 4
    assert {r["doc_id"]: r["keep_id"] for r in result.collect()} == {5: 9, 3: 9, 9: 9, 1: 1, 2: 2, 7: 7}


def test_state_goes_on_over_batches_and_runs(spark, documents, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(s, "LOG_BYTES", 1)
    path, state = str(tmp_path / "docs.parquet"), s.StreamDedup(spark, str(tmp_path / "state"))
    first = [(i, f"text {i % 7}") for i in range(40)]
    later = [(100 + i, f"text  {i % 9}" + " " * (i % 3)) for i in range(40)]
    schema = documents("x").schema
    for rows in (first, later):
        documents(*rows).repartition(4).write.mode("append").parquet(path)
        # A batch of one byte at most is a batch for each file.
        state.run(s.located(s.read_stream(spark, path, schema, most_bytes=1)))
        seen = first if rows is first else first + later
        assert got(state.result(s.located(spark.read.parquet(path)))) == plain(seen)
    assert spark.read.parquet(str(tmp_path / "state" / "hits")).select("batch").distinct().count() > 2


def test_equal_digests_of_different_texts(spark, documents, tmp_path):  # noqa: F811
    rows = [(i, f"w{i % 11}" + " " * (i % 4)) for i in range(60)]
    docs = documents(*rows)
    path = stored(docs, tmp_path, 3)
    poor = s.StreamDedup(spark, str(tmp_path / "state"), digest=lambda t: F.unhex(F.hex(F.crc32(F.encode(t, "UTF-8")) % 3)))
    poor.run(s.located(s.read_stream(spark, path, docs.schema)))
    result = poor.result(s.located(spark.read.parquet(path)))
    assert [x[:3] for x in got(result)] == [x[:3] for x in plain(rows)]
    assert result.where("kept").count() == 11


def test_content_that_has_changed_is_an_error(spark, documents, tmp_path):  # noqa: F811
    path, other = stored(documents("a", "a", "b"), tmp_path), str(tmp_path / "other.parquet")
    state = s.StreamDedup(spark, str(tmp_path / "state"))
    state.run(s.located(s.read_stream(spark, path, spark.read.parquet(path).schema)))
    documents("a").write.parquet(other)
    with pytest.raises(RuntimeError, match="does not hold the rows"):
        state.result(s.located(spark.read.parquet(other)))


def test_empty_table_and_clashing_columns(spark, documents, tmp_path):  # noqa: F811
    assert s.dedup(spark, stored(documents("x").limit(0), tmp_path), str(tmp_path / "none")).collect() == []
    clash = documents("same", "same ").selectExpr("*", "1 AS keep_id", "'f' AS file", "2 AS row", "'d' AS digest", "0 AS kept", "'m' AS _metadata", "3 AS n")
    path = str(tmp_path / "clash.parquet")
    clash.write.parquet(path)
    assert [x[:3] for x in got(s.dedup(spark, path, str(tmp_path / "clash")))] == [(0, 1, 2), (1, 1, 2)]


def test_query_against_plain_grouping(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op11_stream_dedup"](spark, SF).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], key=repr) == plain(docs)
    # The session's own state store is back.
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
