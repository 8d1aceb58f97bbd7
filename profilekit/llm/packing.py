"""Packing of tokenised documents into sequences of fixed length by bounded-space online best-fit.

Pieces arrive in hash order and are dealt into groups of about ``GROUP``. Each
group keeps a fixed number of open sequences in a bitset keyed by free space: a
piece goes where it leaves the least, and when a new sequence is needed and all
are open, the fullest closes. What is still open at a group's end goes on to
the next round as pieces of its own, until one group is left; so the groups'
ends waste nothing, and each round has a sixteenth of the items.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.llm.common import arrow_schema
from profilekit.runtime import cut_lineage, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, END = 2048, 0
#: Open sequences of a group, and pieces of a group (about).
OPEN, GROUP = 512, 8192
VOCABULARY = "byte_bpe_50k.json"
#: Words with their ids that a task remembers, and the longest such word.
KNOWN_WORDS, KNOWN_LENGTH = 400_000, 48


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    Splits of the byte-level vocabulary never reach over a single space before a
    word, so words are encoded once and remembered. A text with other white
    space beside a space is encoded in one go. A text that holds one of the
    vocabulary's added tokens is left to the tokenizer that the file is made for.
    """

    #: White space beside a space, or a space at either end.
    UNEVEN = re.compile(r"\s | \s|\A | \Z")

    def __init__(self, vocabulary: str):
        import json

        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        symbols, special = byte_symbols(), {t["id"] for t in described["added_tokens"]}
        ranks = {bytes(symbols[c] for c in k): v for k, v in described["model"]["vocab"].items() if v not in special}
        # The same vocabulary and merges; this encoder takes a quarter of the time of the one that the file is made for.
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.added = re.compile("|".join(re.escape(t["content"]) for t in described["added_tokens"]) or r"(?!)")
        self.path, self.whole = path, None

    def packed(self, text: str) -> bytes:
        return self.binary(self.encode(text))

    def with_added(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.binary(self.whole.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def binary(numbers) -> bytes:
        ids = array("I", numbers)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added.search(text):
            return self.with_added(text)
        if self.UNEVEN.search(text):
            return self.packed(text)
        first, *words = text.split(" ")
        known, out = self.known, [self.packed(first)]
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self.packed(" " + word)
                if len(word) <= KNOWN_LENGTH:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


PIECES = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """The pieces of each document, its end id 0 included; ``ids``: with the token ids as little-endian 32-bit binary.

    A null or empty text is its end id alone. A document of more than ``length``
    ids is cut into pieces of that length, the first of which may be shorter.
    Repeated rows have pieces of their own, a null id stays null.
    """
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("body"))
    fields = [rows.schema["doc_id"], *PIECES, *([T.StructField("ids", T.BinaryType())] if ids else [])]
    schema = T.StructType(fields)
    arrow = arrow_schema(schema)

    def run(batches):
        words = Words(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in fields[1:]]
            at = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                body = words.ids(text or "") + END.to_bytes(4, "little")
                total = len(body) // 4
                n = -(-total // length)
                start = 0
                for piece in range(n):
                    size = total - length * (n - 1) if piece == 0 else length
                    part = body[4 * start : 4 * (start + size)]
                    at.append(row)
                    for column, value in zip(out, (piece, start, size, zlib.crc32(part), part), strict=False):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, type=f.type) for v, f in zip(out, list(arrow)[1:], strict=True))],
                schema=arrow,
            )

    return rows.mapInArrow(run, schema)


def best_fit(lengths: list[int], length: int, most_open: int) -> tuple[list[int], list[int], set[int]]:
    """Sequence and offset of each item, and the sequences that are open at the end.

    ``free`` is a bitset: bit f is set when an open sequence has f places left.
    """
    free, stacks, n_open, n_bins = 0, [[] for _ in range(length + 1)], 0, 0
    bins, offsets = [], []
    for size in lengths:
        fitting = free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            bin_ = stacks[left].pop()
            if not stacks[left]:
                free ^= 1 << left
            n_open -= 1
        else:
            if n_open == most_open:  # the fullest closes
                fullest = (free & -free).bit_length() - 1
                stacks[fullest].pop()
                if not stacks[fullest]:
                    free ^= 1 << fullest
                n_open -= 1
            bin_, left, n_bins = n_bins, length, n_bins + 1
        bins.append(bin_)
        offsets.append(length - left)
        left -= size
        if left:
            stacks[left].append(bin_)
            free |= 1 << left
            n_open += 1
    return bins, offsets, {b for s in stacks for b in s}


def packed_groups(items: DataFrame, size: str, order: list[str], groups: int, stage: int, length: int, most_open: int) -> DataFrame:
    """``items`` with ``bin``, ``offset`` and ``open``, packed group by group in hash order."""
    schema = T.StructType(
        [*items.schema.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())]
    )

    def pack(key, rows):
        rows = rows.sort_values(["order", *order]).reset_index(drop=True)
        bins, offsets, left = best_fit(rows[size].tolist(), length, most_open)
        first = (stage << 52) | (int(key[0]) << 24)
        rows["bin"] = [first + b for b in bins]
        rows["offset"] = offsets
        rows["open"] = [b in left for b in bins]
        return rows.drop(columns=["group", "order"])

    mixed = F.xxhash64(*[F.col(c) for c in order])
    keyed = items.withColumn("group", F.pmod(F.hash(mixed, F.lit(stage)), F.lit(groups))).withColumn("order", mixed)
    return keyed.groupBy("group").applyInPandas(pack, schema)


def pack(table: DataFrame, length: int = LENGTH, most_open: int = OPEN, group: int = GROUP) -> DataFrame:
    """``table`` of pieces with ``sequence_id`` and ``offset``; an empty table stays empty.

    The result depends on the rows alone, not on their order or partitions.
    """
    table = cut_lineage(table)
    number, stage, done = table.count(), 0, None
    order = ["doc_id", "piece", "ids_crc32", "length"]
    left = cut_lineage(packed_groups(table, "length", order, max(1, math.ceil(number / group)), stage, length, most_open))
    groups = max(1, math.ceil(number / group))
    while groups > 1:
        stage += 1
        closed = left.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        carried = left.where("open").groupBy("bin").agg(F.max(F.col("offset") + F.col("length")).alias("length"))
        carried = carried.select(F.col("bin").alias("from"), "length")
        groups = max(1, math.ceil(groups * most_open / group))
        moves = packed_groups(carried, "length", ["from", "length"], groups, stage, length, most_open)
        moves = moves.select("from", F.col("bin").alias("to"), F.col("offset").alias("shift"), F.col("open").alias("still"))
        moved = left.where("open").join(moves, F.col("bin") == F.col("from"))
        left = cut_lineage(
            moved.select(*table.columns, F.col("to").alias("bin"), (F.col("offset") + F.col("shift")).alias("offset"), F.col("still").alias("open"))
        )
    done = left if done is None else done.unionByName(left)
    return done.select(*table.columns, F.col("bin").alias("sequence_id"), "offset")
