"""Near-copies: candidates by variants of SimHash fingerprints, each verified by the Jaccard similarity of the shingle sets.

Fingerprints of 256 bits are made from the distinct shingles of a text. Six
fixed arrangements of the bits are each cut into sixteen segments. A variant is
a fingerprint with all bits but those of one segment left out; two fingerprints
that share one meet by an equality shuffle, in blocks of bounded size, and are
candidates if they are within a wide distance. Then the shingle sets of the
candidates are brought to the same blocks, and only pairs whose sets have the
similarity asked for become links.

The unit is a set of shingles, not a fingerprint: a digest of the set goes with
the fingerprint, so that equal fingerprints of different sets are verified too.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.llm.common import arrow_schema, with_text_columns
from profilekit.llm.simhash import STEP, VALUE_BITS, SimHash, named_forest, shingles, spun
from profilekit.runtime import cut_lineage, hint_if_small, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of a segment, and arrangements of a fingerprint's bits.
WIDTH, ARRANGEMENTS = 16, 6


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, words)]))


def set_print(found: np.ndarray, lanes: int) -> list[int]:
    """Bits that more than half of the shingles have, as 64-bit integers, and a digest of the set."""
    ones = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(found), STEP):
        for k in range(lanes):
            bits = np.unpackbits(spun(found[at : at + STEP], k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    fingerprint = np.packbits(2 * ones > len(found), axis=1).view(">i8")[:, 0].tolist()
    return [*fingerprint, int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))]


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-6:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= least


@dataclass(frozen=True)
class NearCopies(SimHash):
    """Texts whose sets of shingles of ``words`` words have a Jaccard similarity of ``least`` or more.

    ``distance`` only bounds the candidates. At similarity 0.8 fingerprints
    differ in 15 % of the bits, 39 of 256 with a standard deviation of 6.
    """

    words: int = 5
    lanes: int = 4
    distance: int = 62
    block: int = 1024
    least: float = 0.8

    @property
    def columns(self) -> list[str]:
        return [*(f"f{k}" for k in range(self.lanes)), "node"]

    def segments_of(self, lanes: list[np.ndarray]) -> np.ndarray:
        """The segments of all arrangements, one row for each fingerprint."""
        n, size = len(lanes[0]), 64 * self.lanes
        bits = np.unpackbits(np.ascontiguousarray(np.stack(lanes, axis=1), ">u8").view(np.uint8).reshape(n, -1), axis=1)
        orders = [np.arange(size), *(np.random.default_rng(k).permutation(size) for k in range(1, ARRANGEMENTS))]
        return np.concatenate([np.ascontiguousarray(np.packbits(bits[:, o], axis=1)).view(">u2").astype(np.int64) for o in orders], axis=1)

    def fingerprints(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with the fingerprint in ``f0``, ``f1``, ... and the digest of the set in ``node``; null texts count as empty."""

        def start():
            def compute(texts):
                return list(zip(*[set_print(shingle_set(t, self.words), self.lanes) for t in texts], strict=True)) or [[]] * (self.lanes + 1)

            return compute

        return with_text_columns(docs, text, [T.StructField(c, T.LongType()) for c in self.columns], start)

    def variants(self, prints: DataFrame, whole: bool = False) -> DataFrame:
        """``key`` and fingerprint of every variant; ``whole``: the keys alone."""
        columns = self.columns
        schema = T.StructType([T.StructField(c, T.LongType()) for c in (["key"] if whole else ["key", *columns])])
        arrow = arrow_schema(schema)

        def run(batches):
            for batch in batches:
                lanes = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns[: self.lanes]]
                values = self.segments_of(lanes)
                for s in range(values.shape[1]):
                    key = pa.array(np.int64(s << VALUE_BITS) | values[:, s])
                    yield pa.RecordBatch.from_arrays([key] if whole else [key, *(batch.column(c) for c in columns)], schema=arrow)

        return prints.select(*columns).mapInArrow(run, schema)

    def crowded(self, prints: DataFrame) -> DataFrame:
        """``key`` and ``blocks`` of the variants that hold more fingerprints than a block."""
        counted = self.variants(prints, whole=True).groupBy("key").count().where(F.col("count") > self.block)
        return counted.select("key", F.ceil(F.col("count") / self.block).cast("int").alias("blocks"))

    def first_variant(self, key: np.ndarray, differ: list[np.ndarray]) -> np.ndarray:
        return np.argmax(self.segments_of(differ) == 0, axis=1) == key >> VALUE_BITS

    def candidates(self, prints: DataFrame) -> DataFrame:
        """The rows dealt to blocks that have a candidate in their block."""
        rows = self.dealt(prints)
        arrow = arrow_schema(rows.schema)

        def members(table):
            a, b = self.pairs(self.arrays(table))
            if len(a):
                yield from table.take(np.unique(np.concatenate([a, b]))).cast(arrow).to_batches()

        return rows.mapInArrow(lambda batches: self.whole_groups(batches, members), rows.schema)

    def sets(self, wanted: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """``set`` of each fingerprint of ``wanted``, from the text of the row that has its ``least`` id and digest."""
        body = F.col(quoted(text))
        texts = docs.select(F.col(quoted(doc_id)).alias("id"), F.xxhash64(body).alias("digest"), body.alias("body"))
        named = wanted.select(*self.columns, F.col("least.id").alias("least id"), F.col("least.digest").alias("least digest"))
        same = (F.col("digest") == F.col("least digest")) & F.col("id").eqNullSafe(F.col("least id"))
        held = texts.join(hint_if_small(named), same).select(*self.columns, "body")

        def start():
            return lambda bodies: [[shingle_set(t, self.words).view(np.int64) for t in bodies]]

        held = with_text_columns(held, "body", [T.StructField("set", T.ArrayType(T.LongType()))], start).drop("body")
        return cut_lineage(held.dropDuplicates(self.columns))

    def verified(self, prints: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """Links ``a``, ``b`` (hexadecimal) that connect all sets which verified pairs of candidates connect."""
        members = cut_lineage(self.candidates(prints))
        wanted = cut_lineage(prints.join(members.select(*self.columns).distinct(), self.columns, "left_semi"))
        rows = members.join(self.sets(wanted, docs, doc_id, text), self.columns)
        rows = rows.select("key", "pair", "right", *self.columns, "set").repartition("key", "pair").sortWithinPartitions("key", "pair")
        schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

        def forest(table):
            part = self.arrays(table)
            a, b = self.pairs(part)
            lists = table.column("set").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            # Pairs that verified links connect already need no look.
            root, kept = list(range(len(table))), []
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = i, j
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                if x != y and similar(values[at[i] : at[i + 1]], values[at[j] : at[j + 1]], self.least):
                    root[y] = x
                    kept.append((i, j))
            if kept:
                yield named_forest(part[3:], *np.array(kept).T)

        return rows.mapInArrow(lambda batches: self.whole_groups(batches, forest), schema).distinct()

    def keep_first(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """As ``SimHash.keep_first``, over verified links."""
        return self.kept_by(docs, doc_id, text, lambda prints: self.verified(prints, docs, doc_id, text))
