"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint is cut into so few segments that of two linked fingerprints at
least one segment differs by one bit at most. Each segment is indexed under its
one-wildcard variants (the segment with one bit left out, and which one), so two
such segments share a variant: an equality shuffle brings them together, and
the whole fingerprints are compared there.

Only distinct fingerprints are indexed. A pair is looked at under one variant
alone: the first segment with a difference of one bit at most, at that bit.
What a variant brings together is compared in blocks of bounded size, and a
block hands on a spanning forest of its links, not the pairs. Links become
groups as connected components.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.llm.common import arrow_schema, with_text_columns
from profilekit.llm.components import connected
from profilekit.runtime import cut_lineage, hint_if_small, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
#: Shingles hashed in one step; fingerprints of one variant that are compared in one block.
STEP, BLOCK = 1 << 15, 2048
#: Bits of a variant's key that hold the segment's value.
VALUE_BITS = 24


def shingles(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in steps; a text of fewer words is one shingle, no words are none."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], last[at : at + STEP], strict=False)]
        yield np.array(part, np.uint64)


def spun(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves for ``k`` 0, else further 64 bits of each."""
    if k == 0:
        return hashes
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str, words: int, lanes: int) -> list[int]:
    """A bit is set if more than half of the shingles' hashes have it; one signed integer for each 64 bits."""
    ones, n = np.zeros((lanes, 64), np.int64), 0
    for hashes in shingles(text, words):
        n += len(hashes)
        for k in range(lanes):
            bits = np.unpackbits(spun(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1).view(">i8")[:, 0].tolist()


@dataclass(frozen=True)
class SimHash:
    """Fingerprints of ``64 * lanes`` bits over shingles of ``words`` words, linked at up to ``distance`` differing bits.

    ``segments`` is the number of segments: up to ``2 * segments - 1`` differing
    bits every link is found. A larger ``distance`` may be asked for; then
    links up to it are found whenever one segment differs by at most one bit.
    """

    words: int = 4
    lanes: int = 1
    segments: int = 3
    distance: int = 4
    block: int = BLOCK

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.lanes)]

    @property
    def cuts(self) -> list[tuple[int, int, int]]:
        """Lane, lowest bit and width of each segment; segments don't cross lanes."""
        out = []
        for k in range(self.lanes):
            n = self.segments // self.lanes
            edges = [round(i * 64 / n) for i in range(n + 1)]
            out += [(k, low, high - low) for low, high in zip(edges, edges[1:], strict=False)]
        if self.segments % self.lanes or max(w for _, _, w in out) > VALUE_BITS:
            raise ValueError("segments must be a multiple of lanes and at most 24 bits wide")
        return out

    def fingerprints(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with the fingerprint in columns ``f0``, ``f1``, ...; null texts count as empty, which is zero."""

        def start():
            def compute(texts):
                return list(zip(*[fingerprint(t, self.words, self.lanes) for t in texts], strict=True)) or [[]] * self.lanes

            return compute

        return with_text_columns(docs, text, [T.StructField(c, T.LongType()) for c in self.columns], start)

    def variants(self, prints: DataFrame, whole: bool = False) -> DataFrame:
        """``key`` and fingerprint of every one-wildcard variant; ``whole``: the segments' values and nothing else."""
        cuts, columns = self.cuts, self.columns
        schema = T.StructType([T.StructField(c, T.LongType()) for c in (["key"] if whole else ["key", *columns])])
        arrow = arrow_schema(schema)

        def run(batches):
            for batch in batches:
                lanes = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns]
                for s, (k, low, width) in enumerate(cuts):
                    value = ((lanes[k] >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    if whole:
                        yield pa.RecordBatch.from_arrays([pa.array((s << VALUE_BITS) | value)], schema=arrow)
                        continue
                    for w in range(width):
                        key = (np.int64(s * 32 + w) << VALUE_BITS) | (value & ~np.int64(1 << w))
                        yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in columns)], schema=arrow)

        return prints.select(*columns).mapInArrow(run, schema)

    def crowded(self, prints: DataFrame) -> DataFrame:
        """``key`` and ``blocks`` of the variants that may hold more fingerprints than a block.

        A variant holds the fingerprints of two segment values. Values that fill
        half a block are counted; any other value adds half a block at most.
        """
        most = self.block // 2
        values = self.variants(prints, whole=True).groupBy("key").count().where(F.col("count") > most)
        segment, value = F.shiftright("key", VALUE_BITS), F.col("key").bitwiseAND((1 << VALUE_BITS) - 1)
        width = F.element_at(F.array(*[F.lit(w) for _, _, w in self.cuts]), (segment + 1).cast("int"))
        wild = values.select(segment.alias("s"), value.alias("v"), "count", F.explode(F.sequence(F.lit(0), width - 1)).alias("w"))
        one = F.expr("shiftleft(1L, w)")
        key = F.expr(f"shiftleft(s * 32 + w, {VALUE_BITS})").bitwiseOR(F.col("v").bitwiseAND(F.bitwise_not(one)))
        blocks = F.ceil((F.sum("count") + most) / self.block).cast("int")
        return wild.select(key.alias("key"), "count").groupBy("key").agg(blocks.alias("blocks")).where("blocks > 1")

    def links(self, prints: DataFrame) -> DataFrame:
        """Links ``a``, ``b`` (hexadecimal) between distinct fingerprints, enough of them to connect all that are linked; some repeat.

        A crowded variant is dealt into blocks by hash; each pair of its blocks is a task's group of bounded size.
        """
        run, rows = self.whole_groups, self.dealt(prints)
        schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

        def forest(table):
            part = self.arrays(table)
            a, b = self.pairs(part)
            if len(a):
                yield named_forest(part[3:], a, b)

        return rows.mapInArrow(lambda batches: run(batches, forest), schema)

    def dealt(self, prints: DataFrame) -> DataFrame:
        """The variants by ``key`` and ``pair`` of blocks; ``right`` marks the rows of a pair's second block."""
        columns = self.columns
        hot = cut_lineage(self.crowded(prints))
        rows = self.variants(prints)
        if hot.isEmpty():
            rows = rows.select("key", F.lit(0).cast("long").alias("pair"), F.lit(False).alias("right"), *columns)
        else:
            other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
            rows = rows.join(hint_if_small(hot), "key", "left")
            rows = rows.withColumn("own", F.pmod(F.xxhash64(*columns), F.coalesce("blocks", F.lit(1))).cast("int")).withColumn("other", other)
            low, high = F.least("own", "other").cast("long"), F.greatest("own", "other")
            rows = rows.select("key", F.shiftleft(low, 32).bitwiseOR(high.cast("long")).alias("pair"), (F.col("own") > F.col("other")).alias("right"), *columns)
        return rows.repartition("key", "pair").sortWithinPartitions("key", "pair")

    @staticmethod
    def whole_groups(batches: Iterator[pa.RecordBatch], operate) -> Iterator[pa.RecordBatch]:
        """What ``operate`` yields for tables that hold whole groups of the rows dealt."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key, pair = table.column("key").to_numpy(), table.column("pair").to_numpy()
            changes = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            rest = table.slice(cut)
            if cut:
                yield from operate(table.slice(0, cut))
        if rest is not None and len(rest):
            yield from operate(rest)

    def arrays(self, table: pa.Table) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in ("key", "pair", "right", *self.columns)]

    def pairs(self, part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows that link within a group, each under its first variant alone. ``part``: key, pair, right and columns, by group."""
        return pairs_in_groups(part, self.lanes, self.distance, self.first_variant)

    def first_variant(self, key: np.ndarray, differ: list[np.ndarray]) -> np.ndarray:
        """Whether ``key`` is the first variant that two fingerprints share which differ in these bits."""
        segment, wild = (key >> VALUE_BITS) // 32, (key >> VALUE_BITS) % 32
        first, least = np.full(len(key), -1), np.zeros(len(key), np.int64)
        for s, (k, low, width) in enumerate(self.cuts):
            bits = (differ[k] >> np.uint64(low)) & np.uint64((1 << width) - 1)
            ready = (first < 0) & (np.bitwise_count(bits) <= 1)
            first[ready] = s
            # One differing bit b has b - 1 ones below it; none stands for bit 0.
            least[ready] = np.where(bits[ready] > 0, np.bitwise_count(np.maximum(bits[ready], 1) - np.uint64(1)), 0)
        return (first == segment) & (least == wild)

    def hexadecimal(self):
        return F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in self.columns])

    def groups(self, rows: DataFrame, order, links=None) -> DataFrame:
        """``print`` (hexadecimal) and ``first``, the least ``order`` of its group, for each distinct fingerprint of ``rows``."""
        prints = cut_lineage(rows.groupBy(*self.columns).agg(F.min(order).alias("least")))
        named = prints.select(self.hexadecimal().alias("print"), "least")
        part = connected((links or self.links)(prints)).withColumnRenamed("node", "print")
        named = cut_lineage(named.join(part, "print", "left").withColumn("component", F.coalesce("component", "print")))
        # Cut off from the grouping, so that the join has a shuffle of its own, in which a large component can be split.
        firsts = cut_lineage(named.groupBy("component").agg(F.min("least").alias("first")))
        return named.join(firsts, "component").select("print", "first")

    def assign(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id``, ``fingerprint`` and ``component_id`` (the least id of its group) of every row.

        Rows with a null id take part; the group's id is null only if all its ids are. Repeated rows stay.
        """
        rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("body"))
        rows = cut_lineage(self.fingerprints(rows, "body").select("doc_id", *self.columns))
        named = rows.select("doc_id", self.hexadecimal().alias("fingerprint"))
        groups = self.groups(rows, F.col("doc_id")).select(F.col("print").alias("fingerprint"), F.col("first").alias("component_id"))
        return named.join(groups, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")

    def keep_first(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row of each group of near-copies: the one with the least id (then the least hash of its text).

        Empty and null texts are copies of each other. Exactly repeated rows leave one. All columns stay.
        """
        return self.kept_by(docs, doc_id, text, self.links)

    def kept_by(self, docs: DataFrame, doc_id: str, text: str, links) -> DataFrame:
        """``keep_first`` over the links that ``links`` finds between the distinct fingerprints and their ``least``."""
        digest = F.xxhash64(F.col(quoted(text)))
        rows = docs.select(F.col(quoted(doc_id)).alias("id"), digest.alias("digest"), F.col(quoted(text)).alias("body"))
        rows = cut_lineage(self.fingerprints(rows, "body").select("id", "digest", *self.columns))
        kept = self.groups(rows, F.struct("id", "digest"), links).select("first.id", "first.digest").distinct()
        kept = cut_lineage(kept.select(F.col("id").alias("kept id"), F.col("digest").alias("kept digest")))
        same = F.col(quoted(doc_id)).eqNullSafe(F.col("kept id")) & digest.eqNullSafe(F.col("kept digest"))
        left = docs.join(kept, same, "left_semi")
        repeated = not rows.groupBy("id", "digest").count().where("count > 1").isEmpty()
        return left.dropDuplicates([doc_id, text]) if repeated else left


def named_forest(columns: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links (hexadecimal) that connect the rows which the pairs connect: of each one ``a`` to the least ``b`` that it is connected to.

    A fingerprint that stands in several rows is one end. Stars around the least are what ``connected`` settles in its first round.
    """
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    names, name = np.unique([x.tobytes().hex() for x in np.stack([c[rows] for c in columns], axis=1).astype(">i8")], return_inverse=True)
    ends = name[at]
    root = roots(len(names), ends[: len(a)], ends[len(a) :])
    i = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(names[i], pa.string()), pa.array(names[root[i]], pa.string())], names=["a", "b"])


def pairs_in_groups(part: list[np.ndarray], n_lanes: int, distance: int, first_variant) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group within ``distance`` for which ``first_variant`` holds. ``part``: key, pair, right and lanes, by group."""
    key, pair, right, lanes = part[0], part[1], part[2], [x.view(np.uint64) for x in part[3 : 3 + n_lanes]]
    n = len(key)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
    end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    crossing = (pair >> 32) != (pair & 0xFFFFFFFF)
    live, shift, found_a, found_b = np.arange(n), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(live := live[live + shift + 1 < end[live]]):
        shift += 1
        differ = [x[live] ^ x[live + shift] for x in lanes]
        near = sum(np.bitwise_count(d).astype(np.int64) for d in differ) <= distance
        near &= ~crossing[live] | (right[live] != right[live + shift])
        if near.any():
            a = live[near]
            mine = first_variant(key[a], [d[near] for d in differ])
            found_a.append(a[mine])
            found_b.append(a[mine] + shift)
    return np.concatenate(found_a), np.concatenate(found_b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each index is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
