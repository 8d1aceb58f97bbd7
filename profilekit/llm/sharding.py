"""Shards of nearly equal bytes by fixed virtual slots and a versioned slot-to-shard map.

A record's slot follows from a hash of its id and text checksum and never
changes. Bytes and rows are summed for each slot, and slots, not records, are
given to shards. The map is a small table with a version; rebalancing edits the
map of one version into the next and moves as few slots as it needs.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.llm.common import free_name, without
from profilekit.runtime import quoted

#: Virtual slots. Everything the driver holds is a number for each of them.
SLOTS = 4096
#: Bytes of a record beside its text.
OVERHEAD = 8
#: A shard may exceed the mean by this share before rebalancing moves slots from it.
TOLERANCE = 0.01

MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("virtual_slot", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("first_row", T.LongType()),
    ]
)


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def with_slots(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32`` and ``virtual_slot``; columns of these names are replaced.

    A null text has no bytes and the checksum of an empty one. Null ids and
    repeated rows have slots like any other.
    """
    body = F.coalesce(utf8(F.col(quoted(text))), F.lit(b""))
    crc = F.crc32(body)
    return without(docs, ["size", "text_crc32", "virtual_slot"]).select(
        "*",
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(quoted(doc_id)), crc), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


@dataclass(frozen=True)
class SlotMap:
    """Which shard each slot belongs to, with the bytes and rows of the slots it was made for."""

    version: int
    shards: int
    owner: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]

    @classmethod
    def sums(cls, slotted: DataFrame, slots: int = SLOTS) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Bytes and rows of each slot."""
        size, rows = [0] * slots, [0] * slots
        for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
            size[r.virtual_slot], rows[r.virtual_slot] = r["size"], r["rows"]
        return tuple(size), tuple(rows)

    @classmethod
    def first(cls, slotted: DataFrame, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: the largest slots first, each to the shard with the fewest bytes (then rows, then number)."""
        size, rows = cls.sums(slotted, slots)
        heap, owner = [(0, 0, k) for k in range(shards)], [0] * slots
        for s in sorted(range(slots), key=lambda s: (-size[s], s)):
            total, n, k = heapq.heappop(heap)
            owner[s] = k
            heapq.heappush(heap, (total + size[s], n + rows[s], k))
        return cls(1, shards, tuple(owner), size, rows)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, k in enumerate(self.owner):
            out[k] += self.size[s]
        return out

    def rebalanced(self, shards: int | None = None, slotted: DataFrame | None = None) -> SlotMap:
        """The next version: for more shards, for new sums of the slots, or both.

        Only slots of overfull shards (and of shards that are gone) move: the
        largest that still fits goes to the emptiest shard.
        """
        shards = self.shards if shards is None else shards
        size, rows = (self.size, self.rows) if slotted is None else self.sums(slotted, len(self.owner))
        owner, load = list(self.owner), [0] * shards
        of: dict[int, list[int]] = {k: [] for k in range(shards)}
        loose = []
        for s, k in enumerate(owner):
            if k < shards:
                load[k] += size[s]
                of[k].append(s)
            else:
                loose.append(s)
        mean = sum(size) / shards
        for k in range(shards):
            for s in sorted(of[k], key=lambda s: (-size[s], s)):
                if load[k] <= mean * (1 + TOLERANCE):
                    break
                if size[s] and load[k] - size[s] >= mean * (1 - TOLERANCE):
                    load[k] -= size[s]
                    loose.append(s)
        heap = [(load[k], k) for k in range(shards)]
        heapq.heapify(heap)
        for s in sorted(loose, key=lambda s: (-size[s], s)):
            total, k = heapq.heappop(heap)
            owner[s] = k
            heapq.heappush(heap, (total + size[s], k))
        return replace(self, version=self.version + 1, shards=shards, owner=tuple(owner), size=size, rows=rows)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each slot, with the number of rows that its shard has before it."""
        before, out = [0] * self.shards, []
        for s, k in enumerate(self.owner):
            out.append((self.version, s, k, before[k]))
            before[k] += self.rows[s]
        return spark.createDataFrame(out, MAP_SCHEMA)

    def write(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's history."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def read(spark: SparkSession, path: str, version: int) -> DataFrame:
        return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").where(F.col("version") == version)


def place(slotted: DataFrame, map_table: DataFrame, order: list[str]) -> DataFrame:
    """``slotted`` with ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    Columns of these names are replaced, others stay. ``order`` may name neither.
    The map is as long as the number of slots, so it is broadcast; places are
    counted slot by slot, not shard by shard. Equal rows take places in any order.
    """
    kept = without(slotted, ["shard", "slot"])
    first = free_name(kept, "first row")
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order)) - 1
    return (
        kept.join(F.broadcast(map_table.select("virtual_slot", "shard", F.col("first_row").alias(first))), "virtual_slot")
        .withColumn("slot", F.col(quoted(first)) + rank)
        .drop(first)
    )
