import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilekit.llm import components
from profilekit.llm.components import connected
from profilekit.llm.simhash import SimHash, fingerprint, named_forest
from corpus_fixtures import documents, odd  # noqa: F401


def naive(values, distance):
    """Least index reachable over links of at most ``distance`` differing bits."""
    group = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= distance and group[j] < group[i]:
                    group[i], changed = group[j], True
    return group


def prints(spark, values):
    return spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "f0 long")


def test_fingerprint_counts_bits_of_sparks_own_hash(spark):
    text = "The quick brown FOX jumps over the lazy dog the quick brown fox jumps"
    words = text.lower().split()
    rows = spark.createDataFrame([(" ".join(words[i : i + 4]),) for i in range(len(words) - 3)], "s string")
    hashes = [r[0] & (1 << 64) - 1 for r in rows.select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(text, 4, 1)[0] & (1 << 64) - 1 == want
    assert fingerprint("", 4, 1) == [0] and fingerprint(" \n", 4, 1) == [0]
    two = spark.createDataFrame([("a é",)], "s string").select(F.xxhash64("s")).first()[0]
    assert fingerprint("A\té", 4, 1) == [two]


@pytest.mark.parametrize("block", [4, 2048])
def test_links_equal_brute_force_also_in_crowded_variants(spark, block):
    rng = random.Random(3)
    centre, values = rng.getrandbits(64), []
    for _ in range(60):
        values.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    values += [rng.getrandbits(64) for _ in range(40)] + [0, 1, (1 << 64) - 1]
    values = sorted(set(values))
    got = connected(SimHash(block=block).links(prints(spark, values)))
    part = {int(r.node, 16): int(r.component, 16) for r in got.collect()}
    groups = naive(values, 4)
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            assert (part.get(a, a) == part.get(b, b)) == (groups[i] == groups[j])


def test_every_distance_up_to_the_limit_is_found_wherever_the_bits_are(spark):
    rng = random.Random(5)
    for d in (1, 4):
        a = [rng.getrandbits(64) for _ in range(80)]
        b = [x ^ sum(1 << k for k in rng.sample(range(64), d)) for x in a]
        got = connected(SimHash().links(prints(spark, a + b)))
        part = {int(r.node, 16): r.component for r in got.collect()}
        assert all(part[x] == part[y] for x, y in zip(a, b))


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    part = {r.node: r.component for r in connected(edges).collect()}
    assert len({part[i] for i in range(301)}) == 1 and part[1001] == part[1000] != part[0] and len(part) == 303


def test_links_are_stars_around_the_least_fingerprint():
    values = np.array([9, -1, 5, 9, 2, 7])  # -1 is the largest in hexadecimal; 9 stands in two rows
    got = named_forest([values], np.array([0, 3, 1]), np.array([1, 2, 2])).to_pydict()
    name = lambda v: f"{v & (1 << 64) - 1:016x}"
    assert set(zip(got["a"], got["b"])) == {(name(9), name(5)), (name(-1), name(5))}


def test_a_star_takes_one_round_and_no_broadcast(spark, monkeypatch):
    plans, cut = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([(f"{i:03d}", "000") for i in range(1, 400)] + [("x", "y"), ("x", "y")], "a string, b string")
    part = {r.node: r.component for r in connected(edges).collect()}
    assert len(part) == 402 and {part[f"{i:03d}"] for i in range(400)} == {"000"} and part["x"] == part["y"] == "x"
    assert len(plans) == 5 and not any("Broadcast" in p for p in plans)


def test_assign_on_odd_rows(odd):
    rows = SimHash().assign(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert by["0" * 16] == {0}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}


def test_empty_table(documents):
    assert SimHash().assign(documents()).count() == 0
    assert SimHash().keep_first(documents()).count() == 0


def test_near_copies_leave_one(documents):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [[word() for _ in range(300)] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        near = list(t)
        for k in rng.sample(range(300), 3):
            near[k] = word()
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(t)), (i, " ".join(t))]
    stage = SimHash(words=5, lanes=2, segments=8, distance=23)
    kept = stage.keep_first(documents(*rows).withColumn("component", F.lit("own")))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "component"]


def test_segments_must_divide():
    with pytest.raises(ValueError):
        SimHash(lanes=2, segments=3).cuts  # noqa: B018
