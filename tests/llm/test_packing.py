import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from profilekit.llm.packing import VOCABULARY, Words, best_fit, pack, pieces
from corpus_fixtures import documents, odd  # noqa: F401


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


WORDS = Words(VOCABULARY)
TEXT = st.lists(
    st.one_of(st.characters(codec="utf-8"), st.sampled_from([*" \n\t  .,'sdé1<|>", "<|endoftext|>", "endoftext|>", " word"])), max_size=60
).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_the_tokenizers(tokenizer, text):
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts(tokenizer):
    assert np.frombuffer(WORDS.ids("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    assert WORDS.added.pattern and tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]


def naive_fit(lengths, length, most_open):
    """Every open sequence is looked at."""
    bins, where, free = [], {}, {}
    for size in lengths:
        fitting = [b for b in free if free[b] >= size]
        if fitting:
            b = min(fitting, key=lambda b: free[b])
        else:
            if len(free) == most_open:
                del free[min(free, key=lambda b: free[b])]
            b = len(where)
            where[b] = 0
            free[b] = length
        bins.append(free[b] - size)
        where[b] += size
        free[b] -= size
        if not free[b]:
            del free[b]
    return bins, len(where)


@pytest.mark.parametrize("most_open", [1, 3, 50])
def test_best_fit_equals_a_plain_search(most_open):
    rng = random.Random(most_open)
    lengths = [rng.randint(1, 64) for _ in range(400)]
    bins, offsets, left = best_fit(lengths, 64, most_open)
    rest, n = naive_fit(lengths, 64, most_open)
    assert max(bins) + 1 == n and [64 - o - s for o, s in zip(offsets, lengths)] == rest
    assert len(left) <= most_open


def check(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by)


def test_pieces_and_packing_of_odd_texts(odd, tokenizer):
    table = pieces(odd, ids=True)
    rows = table.collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.piece, r.start), []).append(r)
    for row in odd.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [0]
        n = -(-len(ids) // 2048)
        start = 0
        for k in range(n):
            size = len(ids) - 2048 * (n - 1) if k == 0 else 2048
            data = np.array(ids[start : start + size], "<u4").tobytes()
            assert any(r.length == size and r.ids_crc32 == zlib.crc32(data) and r.ids == data for r in by[row.doc_id, k, start])
            start += size
    packed = pack(pieces(odd)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.length) for r in packed) == sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.length) for r in rows)
    check(packed, 2048)


@pytest.mark.parametrize("group", [40, 10_000])
def test_rounds_carry_what_is_open(spark, group):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.randint(1, 100), i) for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(table, 100, 8, group).collect()
    assert sorted(r.doc_id for r in got) == list(range(1200))
    assert check(got, 100) <= 1.2 * sum(r[3] for r in rows) / 100
    again = pack(table.repartition(7), 100, 8, group).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_empty_table(documents):
    assert pack(pieces(documents())).count() == 0
