"""The divergence audit against a plain sum over all terms."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest import SF

from check_queries import compare, database
from profilekit.llm import divergence as d
from profilekit.llm.common import LOWER, UPPER
from profilekit.llm.queries import ORACLES, QUERIES

LOWERED = str.maketrans(UPPER, LOWER)


def plain(docs, least=3, top=200):
    tokens = [(lang or "", source or "", re.findall(d.TERM, (text or "").translate(LOWERED))) for text, lang, source in docs]
    held, total, by = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in tokens:
        held[lang].update(set(words))
        total[lang].update(words)
        by[lang, source].update(words)
    out = []
    for lang in held:
        terms = sorted(t for t, n in held[lang].items() if n >= least)
        v = len(terms)

        def shares(counts):
            n = sum(counts[t] for t in terms)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + v) for t in terms}

        overall = shares(total[lang])
        sources = {s: shares(c) for (x, s), c in by.items() if x == lang}
        for s, p in sources.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in terms), o) for o, q in sources.items() if o != s]
            items = [((p[t] - overall[t]) ** 2 // overall[t], t) for t in terms if by[lang, s][t] and p[t] > overall[t]]
            for part, found, most in (("pair", pairs, None), ("term", items, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "äbcdéfghij"] * 3
    docs = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "b", "c", "é", None])
        some = [words[int(rng.paretovariate(0.6)) % 780] for _ in range(rng.choice([0, 3, 80, 300]))]
        docs.append((" ".join(some) if i % 17 else None, lang, source))
    docs += [("Word WORD wörd WÖRD 12 a-b " * 2000, "en", "long"), ("only once here", "xx", "s"), ("", "xx", "t"), ("ab", "en", "a")]
    docs += [docs[0]] * 4
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string, source string")


def test_against_plain_sums(spark, corpus):
    assert rows(d.audit(frame(spark, corpus).repartition(5))) == plain(corpus)


def test_blocks_of_few_cells_and_short_lists(spark, corpus, monkeypatch):
    monkeypatch.setattr(d, "CELLS", 64)
    assert rows(d.audit(frame(spark, corpus), top=5)) == plain(corpus, top=5)


def test_counts_handed_on_early_and_long_texts(spark, corpus, monkeypatch):
    monkeypatch.setattr(d, "ENTRIES", 10)
    monkeypatch.setattr(d, "LONG_TEXT", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    assert rows(d.audit(frame(spark, corpus))) == plain(corpus)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_terms_kept(spark):
    docs = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None)]
    assert rows(d.audit(frame(spark, docs))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert rows(d.audit(frame(spark, []))) == []


def test_clashing_columns(spark, corpus):
    more = frame(spark, corpus).selectExpr("*", "1 AS term", "2 AS n", "3 AS block", "4 AS p", "5 AS value", "'i' AS item", "6 AS terms")
    assert rows(d.audit(more)) == plain(corpus)


def test_joint_takes_one_group(spark):
    columns = {"lang": ["en"], "source": ["a"], "p": [5], "p0": [1]} | {w: [1] for w in d.WORDS}
    assert d.joint(pa.table(columns)).num_rows == 0


def test_query_matches_sql(spark):
    got = QUERIES["op13_source_divergence"](spark, SF).toPandas()
    assert compare(got, database(SF).execute(ORACLES["op13_source_divergence"]).df()) is None


def test_terms_are_limited_before_the_shuffle(spark, corpus):
    plan = d.audit(frame(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
