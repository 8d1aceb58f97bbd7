"""Benchmark text in documents, found by spaced seeds.

A mask fixes some of the word positions of a window and ignores the rest. Of
the nine masks here, six words each, at least one fits into every overlap that
counts, twelve words or more of which 75 % are equal, wherever the substituted
words are: a text without a hit has a smaller share in each piece of 12 to 23
words, and every longer overlap is made of such pieces. Hashes of all masked
windows of the documents are joined with those of the benchmark; around each
hit the two texts are compared word by word on the hit's diagonal, and the
longest stretch that tolerates substitutions is what counts.

Only windows that pass a bit filter of the benchmark's hashes are shuffled. Its
size follows the benchmark up to a bound (128 MB); beyond some seven million
benchmark words it lets more windows through, and the join does more of the work.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.llm.common import arrow_schema, free_name, with_text_columns, without
from profilekit.runtime import LOOKUP_ROWS, cut_lineage, hint_if_small, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of the window that the masks lie in, and the masks. Of a mask only the distances of its words count.
SPAN = 12
MASKS = (
    (0, 1, 2, 4, 6, 7), (0, 1, 4, 8, 9, 10), (0, 2, 3, 5, 6, 7), (0, 1, 2, 3, 4, 5), (0, 1, 2, 5, 6, 8),
    (0, 1, 2, 3, 6, 8), (0, 2, 4, 6, 9, 10), (0, 2, 3, 4, 5, 6), (1, 2, 3, 8, 9, 11),
)
#: Shortest overlap in words that counts, least share of equal words in it; shorter items must appear as a whole.
LEAST_WORDS, LEAST_EQUAL, SHORTEST_ITEM = 12, 0.75, 5
#: Words looked at in one step.
STEP = 1 << 16
#: Least and most bits of the filter, as powers of two; places of a hash in it, and how far their bits lie apart in the hash.
FILTER_LEAST, FILTER_MOST, PLACES, APART = 22, 30, 4, 11
#: Odd factors, one for each word of a mask.
FACTORS = [np.uint64(((k + 1) * 0x9E3779B97F4A7C15 | 1) & (1 << 64) - 1) for k in range(SPAN)]

FIELDS = [
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("overlap_words", T.IntegerType()),
    T.StructField("overlap_equal", T.DoubleType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("first_word", T.LongType()),
]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: runs without white space, A-Z in lower case, marks at either end off."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w.strip(b".,;:!?\"'()[]")) for w in text.encode("utf-8", "replace").lower().split()], np.uint64)


def scaled(words: np.ndarray) -> list[np.ndarray]:
    """The words times each factor, from which the hashes under all masks are sums."""
    return [words * f for f in FACTORS]


def masked(products: list[np.ndarray], mask: tuple[int, ...], tag: int) -> np.ndarray:
    """Hash of each window under a mask that begins with 0."""
    n = max(0, len(products[0]) - mask[-1])
    total = np.full(n, FACTORS[0] * np.uint64(tag + 1))
    for k, i in enumerate(mask):
        total += products[k][i : i + n]
    return total


def tagged_masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """The masks from position 0, and for each size of short items one that takes all words; tags keep their hashes apart."""
    return [(t, tuple(i - m[0] for i in m)) for t, m in enumerate(MASKS)] + [(len(MASKS) + n, tuple(range(n))) for n in short]


def windows(texts: list[np.ndarray], masks: list[tuple[int, tuple[int, ...]]], wanted: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tag, text, hash and first word of the masked windows within one text that ``wanted(hashes)`` marks, a step at a time."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = np.concatenate([*texts, np.zeros(0, np.uint64)])
    for start in range(0, len(words), STEP):
        products = scaled(words[start : start + STEP + SPAN - 1])
        for tag, mask in masks:
            hashes = masked(products, mask, tag)[:STEP]
            at = np.flatnonzero(wanted(hashes))
            text = np.searchsorted(bounds, start + at, "right") - 1
            inside = start + at + mask[-1] < bounds[text + 1]
            at, text = at[inside], text[inside]
            yield tag, text, hashes[at], start + at - bounds[text]


def digest(text: Column) -> Column:
    """What stands for a text in joins; equal texts share their result."""
    return F.unhex(F.sha2(text, 256))


def with_words(texts: DataFrame) -> DataFrame:
    """``texts`` with ``words``, the hashes of the words of ``body``, in place of it."""
    field = T.StructField("words", T.BinaryType())
    return with_text_columns(texts, "body", [field], lambda: lambda bodies: [[word_hashes(b).tobytes() for b in bodies]]).drop("body")


def benchmark_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item``, ``id`` and ``words`` of the benchmark's distinct texts; equal texts count under their least id."""
    body = F.col(quoted(text))
    distinct = benchmark.where(body.isNotNull()).groupBy(body.alias("body")).agg(F.min(quoted(item_id)).cast("long").alias("id"))
    distinct = distinct.select(digest(F.col("body")).alias("item"), F.coalesce("id", F.lit(-1)).alias("id"), "body")
    return with_words(distinct).where(F.length("words") >= 8 * SHORTEST_ITEM)


def benchmark_windows(items: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """``item``, ``key`` and ``place`` of the masked windows of all items; a short item has one, the whole of it."""
    schema = T.StructType([T.StructField("item", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("place", T.LongType())])
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(w, np.uint64) for w in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            for tag, text, keys, places in windows(texts, masks, lambda hashes: np.ones(len(hashes), bool)):
                own = (sizes[text] >= SPAN) if tag < len(MASKS) else (sizes[text] == tag - len(MASKS))
                columns = [batch.column(0).take(pa.array(text[own])), pa.array(keys[own].view(np.int64)), pa.array(places[own])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return items.select("item", "words").mapInArrow(run, schema)


def bit_filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array in which each key has its places, and the power of two of its size, which is bounded."""
    size = min(FILTER_MOST, max(FILTER_LEAST, 5 + keys.count().bit_length()))
    places = F.array(*[F.shiftrightunsigned(F.shiftleft("key", APART * k), 64 - size) for k in range(PLACES)])
    parts = keys.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 15).alias("part"))
    found = parts.agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
    out = np.zeros((1 << size - 15, 4096), np.uint8)
    for part, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1), size


def document_windows(texts: DataFrame, masks: list[tuple[int, tuple[int, ...]]], bits: np.ndarray, size: int) -> DataFrame:
    """``digest``, ``key`` and ``first`` of the windows of ``body`` that the filter lets through."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("first", T.LongType())])
    arrow, broadcast = arrow_schema(schema), texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        held, shift = broadcast.value, np.uint64(64 - size)

        def passes(hashes):
            at = np.arange(len(hashes))
            for k in range(PLACES):
                place = (hashes[at] << np.uint64(APART * k)) >> shift
                at = at[(held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            out = np.zeros(len(hashes), bool)
            out[at] = True
            return out

        for batch in batches:
            for _, text, keys, first in windows([word_hashes(t or "") for t in batch.column(1).to_pylist()], masks, passes):
                if len(text):
                    columns = [batch.column(0).take(pa.array(text)), pa.array(keys.view(np.int64)), pa.array(first)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return texts.select("digest", "body").mapInArrow(run, schema)


def verified(pairs: DataFrame) -> DataFrame:
    """``digest`` and the results for pairs of aligned words (``ours``, ``theirs``) whose longest good stretch counts."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), *FIELDS[1:]])
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = []
            for own, item, whole, first, ours, theirs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                size, share, start = stretch(np.frombuffer(ours, np.uint64) == np.frombuffer(theirs, np.uint64))
                if size >= LEAST_WORDS or (whole < LEAST_WORDS and size == whole and share == 1):
                    found.append((own, size, share, item, first + start))
            columns = zip(*found, strict=True) if found else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pairs.select("digest", "id", "whole", "first", "ours", "theirs").mapInArrow(run, schema)


def stretch(equal: np.ndarray) -> tuple[int, float, int]:
    """Length, equal share and start of the longest run that begins and ends equal and is equal for ``LEAST_EQUAL`` of it.

    With ``s`` the running sum of (1 - share) for equal and -share for unequal
    words, a run from i to j is good when s falls by nothing over it: the
    longest is found from running minima and maxima in linear time.
    """
    first = np.flatnonzero(equal)
    if not len(first):
        return 0, 0.0, 0
    s = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - LEAST_EQUAL, -LEAST_EQUAL))])
    # For each end, the first start that is as low: the running minimum falls, so it is found by bisection.
    lowest, ends = np.minimum.accumulate(s[first]), first + 1
    starts = first[np.searchsorted(-lowest, -(s[ends] + 1e-9), "left")]
    k = int(np.argmax(ends - starts))
    start, end = int(starts[k]), int(ends[k])
    return end - start, float(equal[start:end].mean()), start


def overlaps(texts: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> DataFrame:
    """The longest overlap of each text in ``texts`` (``digest``, ``body``) that has one; of equally long ones that with the
    larger equal share, then the smaller item id, then the earlier word."""
    items = cut_lineage(benchmark_items(benchmark, item_id, item_text))
    sizes = (F.length("words") / 8).cast("long")
    short = [r.n for r in items.select(sizes.alias("n")).where(F.col("n") < SPAN).distinct().orderBy("n").collect()]
    masks = tagged_masks(short)
    seeds = cut_lineage(benchmark_windows(items, masks))
    hits = document_windows(texts, masks, *bit_filter(seeds)).join(hint_if_small(seeds, limit), "key")
    diagonals = cut_lineage(hits.select("digest", "item", (F.col("first") - F.col("place")).alias("shift")).distinct())

    hit = hint_if_small(diagonals.select("digest").distinct(), limit)
    ours = with_words(texts.join(hit, "digest", "left_semi").dropDuplicates(["digest"])).withColumnRenamed("words", "own")
    theirs = hint_if_small(items.withColumn("whole", sizes), limit)
    begin = F.greatest(F.lit(0), -F.col("shift"))
    n = F.least(F.col("whole"), F.length("own") / 8 - F.col("shift")).cast("long") - begin

    def piece(words: str, at: Column) -> Column:
        return F.substring(F.col(words), (at * 8 + 1).cast("int"), (n * 8).cast("int"))

    pairs = diagonals.join(ours, "digest").join(theirs, "item").where(n >= F.least(F.col("whole"), F.lit(LEAST_WORDS)))
    found = verified(pairs.select(
        "digest", "id", "whole", (begin + F.col("shift")).alias("first"),
        piece("own", begin + F.col("shift")).alias("ours"), piece("words", begin).alias("theirs"),
    ))
    rank = F.struct(*[(-F.col(c)).alias(c) for c in ("overlap_words", "overlap_equal")], "item_id", "first_word")
    return cut_lineage(found.groupBy("digest").agg(F.min(rank).alias("best")))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = LOOKUP_ROWS) -> DataFrame:
    """``docs`` with ``contaminated`` and the longest overlap: ``overlap_words``, ``overlap_equal``, ``item_id``, ``first_word``.

    Columns of these names are replaced, others stay. Null and empty texts and an empty
    benchmark give false and zero. Items of fewer than five words are no
    evidence; items of fewer than a window's words must appear as a whole. Every
    row stays, repeated rows included; whole texts are read. The benchmark's
    windows, the texts with hits and the results are joined by broadcast up to
    ``limit`` rows and a bound of bytes, beyond it by shuffle.
    """
    names = [f.name for f in FIELDS]
    columns, own, found = without(docs, names).columns, free_name(docs, "text digest"), free_name(docs, "overlap found")
    texts = docs.select(digest(F.col(quoted(text))).alias("digest"), F.col(quoted(text)).alias("body")).where(F.col("body").isNotNull())
    best = overlaps(texts, benchmark, item_id, item_text, limit).select(F.col("digest").alias(own), F.col("best").alias(found))
    out = without(docs.withColumn(own, digest(F.col(quoted(text)))), names).join(hint_if_small(best, limit), own, "left")
    value = {f.name: F.col(quoted(found))[f.name] for f in FIELDS[1:]}
    return out.select(
        *[F.col(quoted(c)) for c in columns], F.col(quoted(found)).isNotNull().alias("contaminated"),
        F.coalesce(-value["overlap_words"], F.lit(0)).alias("overlap_words"),
        F.coalesce(-value["overlap_equal"], F.lit(0.0)).alias("overlap_equal"),
        value["item_id"].alias("item_id"), value["first_word"].alias("first_word"),
    )
