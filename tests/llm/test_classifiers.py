import random

import pytest
from pyspark.sql import functions as F

from profilekit.llm import quality, queries, toxicity
from profilekit.llm.toxicity import Grammar
from corpus_fixtures import documents, odd  # noqa: F401

SF = "/root/testdata/sf0.01"


def score(text, grammar=None):
    return (grammar or Grammar()).score(text, {}, set())[0]


def test_grammar_scores_clauses_not_words():
    assert score("You are an idiot.") >= 0.7 > score("What an idiot.") > 0.3
    assert score("What an idiot, what a moron.") >= 0.7
    assert score("Some idiot wrote this. The moron left.") >= 0.7
    assert score("You are not an idiot.") < 0.2
    assert score("He said they are idiots.") < 0.5
    assert score("You are no fool. They are idiots!") >= 0.7
    assert score("I will kill you") >= 0.7
    assert score("I will kill the process") == 0
    assert score("You will kill time") == 0
    assert score("I will not kill you") == 0
    assert score("We never said anything about you and them.") == 0
    assert score("") == 0


def test_negation_reaches_a_few_words_and_one_clause():
    assert score("Not today; you idiot") >= 0.7
    assert score("not one two three, you four idiot") >= 0.7 > score("not one, you idiot")


def by_hand(symbols):
    """Marks of each symbol by looking at the whole clause, without machines."""
    T = toxicity
    out = []
    for i, kind in enumerate(symbols):
        marks = 0
        if kind in (T.INSULT, T.THREAT):
            marks |= T.NEGATED * (T.NEGATION in symbols[max(0, i - T.REACH_NEGATION) : i])
            marks |= T.REPORTED * (T.REPORT in symbols[:i])
        if kind == T.THREAT and not marks & T.NEGATED:
            since = max([k + 1 for k in range(i) if symbols[k] == T.THREAT], default=0)
            # An intention after the last person, or before a person none.
            told = "".join("p" if s == T.PERSON else "i" for s in symbols[since:i] if s in (T.PERSON, T.INTENT))
            marks |= T.MENACING * ("p" in told and told.endswith("i"))
        out.append(marks)
    aimed = lambda i: symbols[i] == T.INSULT or out[i] & T.MENACING
    meant = lambda k: symbols[k] == T.INSULT and not out[k] & (T.NEGATED | T.REPORTED)
    near = lambda i, reach: [k for k in range(max(0, i - reach), min(len(symbols), i + reach + 1)) if k != i]
    more = [
        T.TARGETED * bool(aimed(i) and any(symbols[k] == T.TARGET for k in near(i, T.REACH_TARGET)))
        | T.HEAPED * (symbols[i] == T.INSULT and any(meant(k) for k in near(i, T.REACH_HEAP)))
        for i in range(len(symbols))
    ]
    return [s | a | b for s, a, b in zip(symbols, out, more, strict=True)]


def test_composed_transducers_equal_a_look_at_the_whole_clause():
    rng = random.Random(2)
    for _ in range(20_000):
        symbols = rng.choices(range(8), weights=[rng.random() ** 2 + 0.01 for _ in range(8)], k=rng.randrange(25))
        tape = toxicity.transduce(toxicity.BACKWARD, reversed(toxicity.transduce(toxicity.FORWARD, symbols)))[::-1]
        assert tape == by_hand(symbols), symbols


def test_machines_read_what_others_have_written():
    menaced = lambda text: Grammar().score(text, {}, set())[1]
    assert menaced("I will kill you") == 1 and menaced("I will never kill you") == 0
    assert menaced("idiots and morons") == 1 and menaced("no idiots and morons") == menaced("he said idiots and morons") == 0


def test_words_are_learned_from_several_contexts(spark, documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, labels = [], []
    for i in range(200):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words.insert(rng.randrange(40), "zorblatt")
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    copy = " ".join(word() for _ in range(40)) + " qwmntp"
    rows += [(1000 + i, copy) for i in range(50)]
    labels += [(1000 + i, 1) for i in range(50)]
    marked = spark.createDataFrame([*labels, (1, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    grammar = toxicity.learn(documents(*rows), marked)
    assert "zorblatt" in grammar.words and "qwmntp" not in grammar.words
    assert score("you zorblatt", grammar) >= 0.7 > score("a zorblatt b", grammar) > 0


@pytest.mark.parametrize("op", ["op1", "op5"])
def test_odd_texts_and_clashing_columns(spark, odd, op):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd.withColumn("score", F.lit("own")).withColumn("toxic_words", F.lit(7))
    if op == "op1":
        out = quality.score(docs, quality.fit(docs, none))
        assert {r.score for r in out.collect()} == {0.5}
        some = spark.createDataFrame([(3, 1), (4, 0), (0, 0)], "doc_id long, quality int")
        scored = quality.score(docs, quality.fit(docs, some)).collect()
        assert all(0 <= r.score <= 1 for r in scored)
    else:
        scored = toxicity.score(docs, toxicity.learn(docs, none)).collect()
        assert {r.score for r in scored} == {0.0}
    assert len(scored) == odd.count()


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(documents(), quality.fit(documents(), none)).count() == 0
    assert toxicity.score(documents(), toxicity.learn(documents(), none)).count() == 0


def test_vote_is_the_brute_force_vote(spark, documents):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["alpha", "beta!", "GAMMA", "x|y", "12"], k=rng.randint(1, 60)))) for i in range(80)]
    docs = documents(*rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 80, 2)] + [(i, 1) for i in range(1, 20, 2)], "doc_id long, quality int")
    v = quality.fit(docs, labels)
    import numpy as np

    got = {r.doc_id: r.score for r in quality.score(docs, v).collect()}
    for i, text in rows:
        z = quality.unit(quality.weighted(quality.counts(text)[None], v.idf).astype(np.float32) @ v.axes)[0]
        cosine = v.vectors @ z
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 0).astype(float) ** 4
        assert got[i] == pytest.approx((w * v.labels[near]).sum() / w.sum(), abs=0.08)


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality_votes", "quality", 0.95), ("op5_toxicity_grammar", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    rows = queries.QUERIES[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = rows.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]
    assert held >= least


def test_a_very_long_labelled_text_equals_itself(spark, documents):
    """Trigrams counted beyond 16 bits are the same in the sample and in what is scored."""
    texts = ["ab " * 150_000 + "end", "Plain words about weather.", "Other words, of no note!", "12 34 56"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    voters = quality.fit(documents(*texts), labels)
    rows = [quality.counts(t) for t in texts]
    assert max(r.max() for r in rows) > 65535
    for row in rows:
        own = quality.unit(quality.weighted(row[None, :], voters.idf).astype("float32") @ voters.axes)
        assert (own @ voters.vectors.T).max() > 1 - 1e-5
