import zlib

from pyspark.sql import functions as F

from profilekit.llm import queries
from profilekit.llm.sharding import SlotMap, place, with_slots
from corpus_fixtures import documents, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_query_balances_bytes_and_counts_places(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_shard_slots"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    load, slots = [0] * 24, {k: [] for k in range(24)}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) - min(load) <= max(len(t.encode()) for t in docs.values()) + 8


def test_odd_rows_have_places(spark, odd):
    docs = odd.unionByName(odd).withColumn("size", F.lit("own"))
    slotted = with_slots(docs, slots=16)
    slot_map = SlotMap.first(slotted, 3, 16)
    rows = place(slotted, slot_map.table(spark), ["doc_id", "text_crc32"]).collect()
    assert len(rows) == docs.count()
    for shard in range(3):
        held = sorted(r.slot for r in rows if r.shard == shard)
        assert held == list(range(len(held)))
    assert {r["size"] for r in rows if r.text is None} == {8}


def test_columns_of_other_names_stay(spark, documents):
    docs = documents(*("text %d" % i for i in range(20))).withColumn("shard", F.lit("own")).withColumn("Slot", F.lit(-1)).withColumn("first row", F.lit("mine"))
    slotted = with_slots(docs, slots=8)
    out = place(slotted, SlotMap.first(slotted, 3, 8).table(spark), ["doc_id"])
    assert sorted(c.lower() for c in out.columns) == sorted({c.lower() for c in slotted.columns})
    rows = out.collect()
    assert {r["first row"] for r in rows} == {"mine"} and {r.shard for r in rows} == {0, 1, 2} and min(r.slot for r in rows) == 0


def test_versions_move_few_slots(spark, documents, tmp_path):
    slotted = with_slots(documents(*[(i, "x" * (50 + i % 400)) for i in range(3000)]), slots=256)
    one = SlotMap.first(slotted, 8, 256)
    two = one.rebalanced(shards=9)
    moved = [s for s in range(256) if one.owner[s] != two.owner[s]]
    assert two.version == 2 and max(two.loads()) < 1.15 * sum(two.size) / 9
    assert sum(two.size[s] for s in moved) < 0.25 * sum(two.size)
    gone = two.rebalanced(shards=8)
    assert set(gone.owner) == set(range(8)) and max(gone.loads()) < 1.15 * sum(gone.size) / 8
    same = one.rebalanced()
    assert sum(a != b for a, b in zip(one.owner, same.owner)) <= 8
    for m in (one, two):
        m.write(spark, str(tmp_path))
    assert tuple(r.shard for r in SlotMap.read(spark, str(tmp_path), 2).orderBy("virtual_slot").collect()) == two.owner
    assert SlotMap.read(spark, str(tmp_path), 1).count() == 256


def test_empty_table(spark, documents):
    slotted = with_slots(documents(), slots=8)
    assert place(slotted, SlotMap.first(slotted, 3, 8).table(spark), ["doc_id"]).count() == 0
