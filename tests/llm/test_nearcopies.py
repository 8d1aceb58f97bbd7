"""The near-copies stage against the exact Jaccard similarity of all pairs."""

import random

import corpus_pipeline
from profilekit.llm.nearcopies import NearCopies
from corpus_fixtures import documents, odd  # noqa: F401

STAGE = dict(corpus_pipeline.STAGES)["near-copies"]


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(n)]


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def exact(texts, least=0.8):
    """Ids that exact verification keeps: the least of each component of pairs at ``least`` or more."""
    sets, group = [shingle_set(t) for t in texts], list(range(len(texts)))
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) / max(1, len(a | b)) >= least]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(group[i], group[j])
            changed |= group[i] != low or group[j] != low
            group[i] = group[j] = low
    return set(group)


def test_pairs_below_the_similarity_stay_and_pairs_above_go(spark, documents):
    """Copies with a run of new words at the end: similarities from 0.55 to 0.95, on both sides of 0.8."""
    rng = random.Random(21)
    texts = [words(rng, 204) for _ in range(80)]
    for i in range(80):
        share = 0.55 + 0.4 * i / 79
        cut = round(200 * 2 * share / (1 + share)) + 4
        texts.append(texts[i][:cut] + words(rng, 204 - cut))
    texts = [" ".join(t) for t in texts]
    want = exact(texts)
    assert 100 < len(want) < 140
    assert {r.doc_id for r in STAGE(spark, documents(*texts), "").collect()} == want


def test_a_repeated_run_decides_nothing(spark, documents):
    rng = random.Random(22)
    run = "again and " * 2000
    texts = [run + " ".join(words(rng, 60)) for _ in range(20)]
    assert STAGE(spark, documents(*texts), "").count() == 20


def test_small_blocks_give_the_same(spark, documents):
    rng = random.Random(23)
    base, texts = words(rng, 150), []
    for k in range(60):
        near = list(base)
        for i in rng.sample(range(150), k % 12):
            near[i] = words(rng, 1)[0]
        texts.append(" ".join(near))
    want = exact(texts)
    for block in (8, 1024):
        assert {r.doc_id for r in NearCopies(block=block).keep_first(documents(*texts)).collect()} == want


def test_odd_rows(spark, odd):
    assert {r.doc_id for r in STAGE(spark, odd, "").collect()} == {0, 3, 4, 5, 7, 8, None}
