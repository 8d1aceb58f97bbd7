import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilekit.llm import queries
from profilekit.llm.decontaminate import (
    LEAST_EQUAL, MASKS, SPAN, benchmark_items, benchmark_windows, bit_filter, digest, document_windows, mark, stretch, tagged_masks,
)
from corpus_fixtures import documents, odd  # noqa: F401

SF = "/root/testdata/sf0.001"
RNG = random.Random(8)
WORDS = ["".join(RNG.choices("abcdefghijklm", k=6)) for _ in range(4000)]
ITEMS = [RNG.sample(WORDS, n) for n in (40, 25, 12, 9, 4)]


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(ITEMS)] + [(77, " ".join(ITEMS[0])), (90, None), (91, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def around(words):
    return " ".join([*RNG.sample(WORDS, 30), *words, *RNG.sample(WORDS, 30)])


def test_masks_cover_any_one_substitution():
    assert all(any(i not in m for m in MASKS) for i in range(SPAN))


def test_passages_with_substitutions_are_found_and_clean_text_is_not(documents, benchmark):
    half, changed = ITEMS[0][10:30], list(ITEMS[0])
    for k in (4, 11, 19, 26, 33):
        changed[k] = "other"
    texts = [around(ITEMS[0]), around(half), around(changed), around([w.upper() + "," for w in ITEMS[1]]), around(ITEMS[3]), around(ITEMS[3][:8]), around(ITEMS[4]), around(ITEMS[0][:7]), around([]), around(ITEMS[2])]
    got = {r.doc_id: r for r in mark(documents(*texts).withColumn("item_id", F.lit("own")), benchmark).collect()}
    assert [got[i].contaminated for i in range(10)] == [True, True, True, True, True, False, False, False, False, True]
    assert (got[0].overlap_words, got[0].item_id, got[0].first_word, got[0].overlap_equal) == (40, 0, 30, 1.0)
    assert got[1].overlap_words == 20 and got[2].overlap_words == 40 and got[2].overlap_equal == pytest.approx(35 / 40)
    assert (got[8].overlap_words, got[8].item_id) == (0, None)


@pytest.mark.parametrize("limit", [0, 200_000])
def test_shuffled_and_broadcast_joins_give_the_same(documents, benchmark, limit):
    texts = [around(w) for w in ITEMS] + [around([])]
    got = {r.doc_id: (r.contaminated, r.item_id) for r in mark(documents(*texts), benchmark, limit=limit).collect()}
    assert got == {0: (True, 0), 1: (True, 1), 2: (True, 2), 3: (True, 3), 4: (False, None), 5: (False, None)}


def test_columns_named_like_those_of_the_work_stay(documents, benchmark):
    docs = documents("some text").withColumn("best x", F.lit(1)).withColumn("text digest", F.lit("mine"))
    row = mark(docs, benchmark).first()
    assert row["best x"] == 1 and row["text digest"] == "mine" and row["item_id"] is None


def test_stretch_is_the_longest_good_run():
    rng = np.random.default_rng(3)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 40)) < rng.random()
        best = 0
        for i in range(len(equal)):
            for j in range(i + 1, len(equal) + 1):
                if equal[i] and equal[j - 1] and equal[i:j].mean() >= LEAST_EQUAL:
                    best = max(best, j - i)
        size, share, start = stretch(equal)
        assert size == best
        assert not size or (equal[start : start + size].mean() == pytest.approx(share) and share >= LEAST_EQUAL - 1e-9)


def test_odd_texts_and_empty_tables(spark, odd, documents, benchmark):
    out = mark(odd, benchmark).collect()
    assert len(out) == odd.count() and not any(r.contaminated for r in out)
    assert mark(documents(), benchmark).count() == 0
    assert not any(r.contaminated for r in mark(odd, benchmark.limit(0)).collect())


def test_query_finds_what_plain_search_finds(spark):
    """Documents with 12 consecutive words of an item, by a set of all its 12-word runs."""
    clean = lambda t: [w.strip(".,;:!?\"'()[]") for w in (t or "").lower().split()]
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = clean(r.text)
        runs |= {tuple(words[i : i + 12]) for i in range(len(words) - 11)}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = clean(r.text)
        if any(tuple(words[i : i + 12]) in runs for i in range(len(words) - 11)):
            want.add(r.doc_id)
    rows = queries.QUERIES["op8_spaced_seeds"](spark, SF).collect()
    assert want and want <= {r.doc_id for r in rows if r.contaminated} and len(rows) == 200


def test_a_text_without_a_hit_never_counts():
    """Over all texts without a hit: 1 for each equal word, -3 for each other one, is below 0 for 12 to 23 words, so for more too."""
    n = 1 << SPAN
    states, hit = np.arange(n), np.zeros(n, bool)
    for m in MASKS:
        bits = sum(1 << (m[-1] - i) for i in m)
        hit |= (states & bits) == bits
    most = np.where(states == 0, 0, -1000)
    for length in range(1, 2 * SPAN):
        before, new = np.maximum(most[: n // 2], most[n // 2 :]), np.full(n, -1000)
        new[0::2], new[1::2] = before - 3, before + 1
        new[hit] = -1000
        most = new
        assert length < SPAN or most.max() < 0


def test_substituted_overlaps_equal_a_plain_scan_of_all_diagonals(documents, benchmark):
    rng, texts = random.Random(9), []
    for words in ITEMS[:3]:
        for step in (4, 5):
            texts.append([w if i % step != step - 2 else "other" for i, w in enumerate(words)])
        for share in (0.1, 0.15, 0.2, 0.25, 0.3):
            for _ in range(6):
                gone = set(rng.sample(range(len(words)), round(share * len(words))))
                texts.append([f"new{i}" if i in gone else w for i, w in enumerate(words)])
    texts = [[*rng.sample(WORDS, 7), *t, *rng.sample(WORDS, 9)] for t in texts]
    got = {r.doc_id: r.overlap_words for r in mark(documents(*[" ".join(t) for t in texts]), benchmark).collect()}
    for k, t in enumerate(texts):
        best = 0
        for words in ITEMS[:3]:
            for shift in range(-len(words), len(t)):
                at = [i for i in range(len(words)) if 0 <= i + shift < len(t)]
                size = stretch(np.array([t[i + shift] == words[i] for i in at], bool))[0]
                best = max(best, size if size >= 12 else 0)
        assert got[k] == best
    assert all(got[k] for k in (0, 1, 32, 33))


def test_filter_lets_all_benchmark_windows_through(spark, benchmark):
    items = benchmark_items(benchmark, "item_id", "text")
    masks = tagged_masks([9])
    seeds = benchmark_windows(items, masks)
    texts = benchmark.where("text is not null").select(digest(F.col("text")).alias("digest"), F.col("text").alias("body"))
    passed = document_windows(texts, masks, *bit_filter(seeds))
    want = {(bytes(r.item), r.key, r.place) for r in seeds.collect()}
    got = {(bytes(r.digest), r.key, r.first) for r in passed.collect()}
    assert len(want) > 9 * 40 and want <= got
