"""How the sources of a language diverge in their words, from count-level bitmaps.

For each language the terms in at least ``LEAST_DOCS`` of its documents are kept. A group's share of a term is
``p = 1 + floor(10^9 (count + 1) / (N + V))``, and a term adds ``f = floor((p - q)^2 / q)`` to the divergence from q.

Since p depends on nothing but the count, terms of equal count are alike. The kept terms of a language are numbered by
falling frequency and cut into blocks of ``WIDTH``. For every (block, group, count) a bitset holds the terms with that
count there. For two groups, AND and popcount of two bitsets give the number of terms with counts (a, b), which is
multiplied by f(a, b). Counts of zero have no bitset; they come by complement from the sizes of the levels:

    sum f = (V - K_g - K_h) f(0,0) + sum_a n_g(a) f(a,0) + sum_b n_h(b) f(0,b)
            + sum_ab n(a,b) (f(a,b) - f(a,0) - f(0,b) + f(0,0))

with K terms in a group and n its level sizes. Frequent terms share blocks, so a block has either few terms of many counts
or few counts. A task holds the bitsets of one block, at most ``WIDTH`` for each source of the language; pairs of sources
are made only as rows of the result.

Null text, language and source count as empty; a language without kept terms gives pairs of value 0. Repeated rows are
documents of their own. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilekit.llm.common import LOWER, UPPER
from profilekit.runtime import hint_if_small, quoted, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
#: Terms of a block, and the long columns that hold their bits.
WIDTH = 512
WORDS = [f"w{i}" for i in range(WIDTH // 64)]
#: Different words of groups that a task holds before it hands its counts on.
ENTRIES = 400_000
#: Characters from which the words of a text are counted one by one.
LONG_TEXT = 1 << 20
#: Cells of the joint table that a task computes at once.
CELLS = 1 << 20


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / (total + vocabulary))``, exact for any long count."""
    return F.expr("1L") + F.call_function(
        "div", (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + vocabulary).cast("decimal(20,0)")
    )


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term.

    The words of a text are counted where it is read, so a frequent word leaves a task as a few rows.
    """
    lower, pattern, most, long_text = str.maketrans(UPPER, LOWER), TERM, ENTRIES, LONG_TEXT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern)
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                k = len(n)
                columns = [pa.repeat(lang, k), pa.repeat(source, k), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([held[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                # The words of a very long text are not held in one list.
                written = Counter(find.findall(text) if len(text) < long_text else (m.group() for m in find.finditer(text)))
                counts: dict[str, int] = {}
                for word, k in written.items():
                    word = word.lower() if word.isascii() else word.translate(lower)
                    counts[word] = counts.get(word, 0) + k
                n, held = groups.setdefault((lang, source), (Counter(), Counter()))
                n.update(counts)
                held.update(counts.keys())
            if sum(len(n) for n, _ in groups.values()) > most:
                yield from flushed()
        yield from flushed()

    partial = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def joint(table: pa.Table) -> pa.Table:
    """What the terms that two groups both have in one block add to their divergence; see the formula above."""
    table = table.sort_by("source")
    names, starts = np.unique(np.array(table["source"].to_pylist(), dtype=object), return_index=True)
    bits = np.column_stack([table[w].to_numpy() for w in WORDS]).view("u8")
    p, p0 = table["p"].to_numpy(), table["p0"].to_numpy()
    ends = [*starts[1:], len(p)]

    def f(a, b):
        return (a - b) ** 2 // b

    source, item, value = [], [], []
    for g in range(len(names) - 1):
        end = ends[g]
        others, z = p[end:], p0[starts[g]]
        zeros, edges = p0[end:], starts[g + 1:] - end
        out, back = np.zeros(len(edges), "i8"), np.zeros(len(edges), "i8")
        step = max(1, CELLS // (len(others) * len(WORDS)))
        for at in range(starts[g], end, step):
            rows = slice(at, min(at + step, end))
            n = np.bitwise_count(bits[rows, None, :] & bits[None, end:, :]).sum(axis=2, dtype="i8")
            a = p[rows, None]
            out += np.add.reduceat((n * (f(a, others) - f(a, zeros) - f(z, others) + f(z, zeros))).sum(axis=0), edges)
            back += np.add.reduceat((n * (f(others, a) - f(others, z) - f(zeros, a) + f(zeros, z))).sum(axis=0), edges)
        rest = names[g + 1:].tolist()
        source += [names[g]] * len(rest) + rest
        item += rest + [names[g]] * len(rest)
        value += out.tolist() + back.tolist()
    lang = pa.repeat(table["lang"][0], len(value)) if value else pa.array([], pa.string())
    return pa.table({"lang": lang.cast(pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of the parts ``pair`` and ``term``."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/divergence-{uuid.uuid4()}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    names = {"text": text, "lang": lang, "source": source}
    docs = docs.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(n) for n, c in names.items()])
    groups = stored(docs.select("lang", "source").distinct(), "groups")
    counts = stored(term_counts(docs), "counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    order = ["lang", F.desc("total"), "term"]
    numbered = totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    terms = stored(
        numbered.select("lang", "term", "total", F.shiftright("id", 9).alias("block"), F.col("id").bitwiseAND(WIDTH - 1).cast("int").alias("bit")), "terms"
    )
    languages = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    known = stored(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "known")
    sizes = known.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count("*").alias("k"))
    sized = groups.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_source", "k", "v", "n_lang")]
    )
    zero = F.lit(0).cast("long")
    sized = stored(sized.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("n_source"), F.col("v")))), "sized")
    known = known.join(hint_if_small(sized), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_source"), F.col("v")))

    def word(i: int) -> Column:
        here = F.floor(F.col("bit") / 64) == i
        return F.coalesce(F.bit_or(F.when(here, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64))), zero).alias(WORDS[i])

    bitsets = stored(known.groupBy("lang", "block", "source", "n", "p", "p0").agg(*[word(i) for i in range(len(WORDS))]), "bitsets")
    both = bitsets.groupBy("lang", "block").applyInArrow(joint, "lang string, source string, item string, value long")
    size = sum((F.bit_count(w) for w in WORDS[1:]), F.bit_count(WORDS[0]))
    levels = stored(bitsets.groupBy("lang", "source", "p").agg(F.sum(size).cast("long").alias("terms")), "levels")

    other = sized.select("lang", F.col("source").alias("item"), F.col("k").alias("item_k"), F.col("p0").alias("item_p0"))
    pairs = sized.join(hint_if_small(other), "lang").where(F.col("source") != F.col("item"))
    neither = (F.col("v") - F.col("k") - F.col("item_k")) * distance(F.col("p0"), F.col("item_p0"))
    here = levels.join(hint_if_small(other), "lang").where(F.col("source") != F.col("item"))
    there = levels.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "terms").join(
        hint_if_small(sized.select("lang", "source", "p0")), "lang"
    ).where(F.col("source") != F.col("item"))
    sums = [
        pairs.select("lang", "source", "item", F.coalesce(neither, zero).alias("value")),
        here.select("lang", "source", "item", (F.col("terms") * distance(F.col("p"), F.col("item_p0"))).alias("value")),
        there.select("lang", "source", "item", (F.col("terms") * distance(F.col("p0"), F.col("q"))).alias("value")),
    ]
    for part in sums:
        both = both.unionByName(part)
    by_pair = both.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))
    q = share(F.col("total"), F.col("n_lang"), F.col("v"))
    by_term = known.withColumn("q", q).where(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = by_pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return ranked.unionByName(by_term.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top))
