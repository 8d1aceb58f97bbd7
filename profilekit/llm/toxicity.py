"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and the words of a clause become symbols: insult,
threat verb, target, negation, reporting verb, intention, person or other. Small
transducers rewrite them, each reading the tape that the one before has written:

1. ``negation``  marks an insult or threat verb shortly after a negation;
2. ``report``    marks one in reported speech, to the end of the clause;
3. ``threat``    marks a threat verb after person and intention, unless the tape says that it is negated;
4. ``heap``      marks an insult near another one that the tape leaves neither negated nor reported;
5. ``target``    marks insults, and of the threat verbs those that the tape calls menacing, near a target.

They are composed into two sequential transducers (``compose``): all five read
from left to right, and what they write is read from right to left by the last
two, since targets and other insults stand on either side. A weighted acceptor
then reads the result. An insult with a target or in a heap weighs more than
the word alone, a bare one less than the threshold for a text, a menacing verb
counts only with a target, and negation and report take most of a weight away.
The clause's weight is the noisy-or of these, ``1 - prod(1 - weight)``, and a
text's score the noisy-or of its clauses.

The frame is written down here. The insults are a short seed list and words and
stems learned from labelled texts (``learn``): their weight is the share of
toxic texts among those that hold them, shrunk to the base rate, and they must
occur in several different contexts, so that copies of one text teach nothing.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.llm.common import bounded_labels, id_crc, with_text_columns
from profilekit.runtime import cut_lineage, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INSULTS = "idiot idiots moron morons stupid pathetic worthless scum loser losers trash clown disgusting dumb imbecile".split()
THREATS = "kill hurt beat destroy shoot burn stab strangle murder smash crush punish".split()
TARGETS = "you your yours yourself u he him his she her they them their these those everyone people".split()
NEGATIONS = "not no never nor neither without isn't aren't wasn't don't doesn't didn't won't can't cannot nobody".split()
REPORTS = "said says saying wrote writes claimed claims called calls calling quoted reported according alleged heard".split()
INTENTS = "will would shall should gonna going must i'll we'll want wants".split()
PERSONS = "i we i'll we'll someone somebody".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, PERSON = range(8)
FRAME = {
    w: k
    for k, words in (
        (PERSON, PERSONS), (INTENT, INTENTS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS),
    )
    for w in words
}
#: What a transducer may add to the symbol of an insult or a threat verb.
NEGATED, REPORTED, TARGETED, MENACING, HEAPED = 8, 16, 32, 64, 128
MARKS = NEGATED | REPORTED | TARGETED | MENACING | HEAPED

#: How far, in words, a negation, a target or another insult reaches.
REACH_NEGATION, REACH_TARGET, REACH_HEAP = 4, 6, 6
SEED_WEIGHT, THREAT_WEIGHT = 0.9, 0.9
NEGATED_FACTOR, REPORTED_FACTOR, BARE_FACTOR = 0.1, 0.35, 0.7

#: Lengths of learned stems, least contexts, least share of toxic texts, and texts of prior weight.
STEMS, CONTEXTS, LEAST_SHARE, PRIOR = range(4, 8), 4, 0.6, 4.0

CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD_PATTERN = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
WORD = re.compile(WORD_PATTERN)


#: A transducer: from state (0 first) and symbol to the next state and the symbol that it writes.
Machine = Callable[[int, int], tuple[int, int]]


def negation(left: int, symbol: int) -> tuple[int, int]:
    """The state counts the words that the last negation still reaches."""
    if symbol == NEGATION:
        return REACH_NEGATION, symbol
    return max(0, left - 1), symbol | NEGATED if left and symbol in (INSULT, THREAT) else symbol


def report(inside: int, symbol: int) -> tuple[int, int]:
    if symbol == REPORT:
        return 1, symbol
    return inside, symbol | REPORTED if inside and symbol & ~MARKS in (INSULT, THREAT) else symbol


def threat(state: int, symbol: int) -> tuple[int, int]:
    """Person, then intention, then a threat verb that isn't negated. Other words between keep the state."""
    if symbol == PERSON:
        return 1, symbol
    if symbol == INTENT:
        return 2 if state else 0, symbol
    if symbol & ~MARKS == THREAT:
        return 0, symbol | MENACING if state == 2 and not symbol & NEGATED else symbol
    return state, symbol


def heap(left: int, symbol: int) -> tuple[int, int]:
    if symbol & ~MARKS != INSULT:
        return max(0, left - 1), symbol
    speaks = not symbol & (NEGATED | REPORTED)
    return REACH_HEAP if speaks else max(0, left - 1), symbol | HEAPED if left else symbol


def target(left: int, symbol: int) -> tuple[int, int]:
    if symbol == TARGET:
        return REACH_TARGET, symbol
    aimed = symbol & ~MARKS == INSULT or symbol & MENACING
    return max(0, left - 1), symbol | TARGETED if left and aimed else symbol


def compose(machines: Sequence[Machine], alphabet: Iterable[int]) -> list[dict[int, tuple[int, int]]]:
    """The machines in a row as one: for each reachable state a table from symbol to next state and symbol written."""
    alphabet, first = list(alphabet), (0,) * len(machines)
    number, tables = {first: 0}, []
    for states in (waiting := [first]):
        table = {}
        for symbol in alphabet:
            written, after = symbol, []
            for machine, state in zip(machines, states, strict=True):
                state, written = machine(state, written)
                after.append(state)
            if tuple(after) not in number:
                number[tuple(after)] = len(number)
                waiting.append(tuple(after))
            table[symbol] = (number[tuple(after)], written)
        tables.append(table)
    return tables


FORWARD = compose([negation, report, threat, heap, target], range(8))
#: Reads from the right what the first has written.
BACKWARD = compose([heap, target], {written for table in FORWARD for _, written in table.values()})


def transduce(tables: list[dict[int, tuple[int, int]]], symbols: Iterable[int]) -> list[int]:
    state, tape = 0, []
    for symbol in symbols:
        state, written = tables[state][symbol]
        tape.append(written)
    return tape


def clause_weight(symbols: Sequence[int], weights: Sequence[float]) -> tuple[float, int, bool]:
    """The weight of a clause, its number of insults and aimed threats, and whether one is aimed or heaped and meant."""
    tape = transduce(BACKWARD, reversed(transduce(FORWARD, symbols)))
    rest, n, matched = 1.0, 0, False
    for symbol, weight in zip(reversed(tape), weights, strict=True):
        kind, strong = symbol & ~MARKS, bool(symbol & (TARGETED | HEAPED))
        if kind == THREAT and symbol & MENACING and symbol & TARGETED:
            weight = THREAT_WEIGHT
        elif kind == INSULT:
            weight = 1 - (1 - weight) ** 2 if strong else weight * BARE_FACTOR
        else:
            continue
        if symbol & NEGATED:
            weight *= NEGATED_FACTOR
        if symbol & REPORTED:
            weight *= REPORTED_FACTOR
        n += 1
        matched |= strong and not symbol & (NEGATED | REPORTED)
        rest *= 1 - min(weight, 0.999)
    return 1 - rest, n, matched


@dataclass
class Grammar:
    """Insults and stems with their weights, and words that only share a stem with insults; the rest of the grammar is fixed."""

    words: dict[str, float] = field(default_factory=lambda: {w: SEED_WEIGHT for w in INSULTS})
    stems: dict[str, float] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)

    def insult(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        if word in self.clean:
            return weight
        for n in STEMS:
            if len(word) > n:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        return weight

    def symbol(self, word: str) -> tuple[int, float]:
        low = word.lower().replace("’", "'")
        weight = self.insult(low)
        return (INSULT, weight) if weight else (FRAME.get(low, OTHER), 0.0)

    def score(self, text: str, known: dict[str, tuple[int, float]], hits: set[str]) -> tuple[float, int, int]:
        """Score in 0 to 1, clauses with an aimed or heaped insult or an aimed threat, and words that carry weight.

        ``known`` keeps the symbols of words seen before, ``hits`` those among them that can carry weight.
        """
        words = set(WORD.findall(text))
        for word in words:
            if word not in known:
                known[word] = entry = self.symbol(word)
                if entry[0] in (INSULT, THREAT):
                    hits.add(word)
        if words.isdisjoint(hits):
            return 0.0, 0, 0
        rest, clauses, n = 0.0, 0, 0
        for clause in CLAUSE.finditer(text):
            words = WORD.findall(clause[0])
            if hits.isdisjoint(words):
                continue
            symbols, weights = zip(*[known[w] for w in words], strict=True)
            weight, carrying, matched = clause_weight(symbols, weights)
            rest += math.log1p(-min(weight, 0.999999))
            clauses += matched
            n += carrying
        return -math.expm1(rest), clauses, n


FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("toxic_clauses", T.IntegerType()),
    T.StructField("toxic_words", T.IntegerType()),
]
#: Words whose symbols a task remembers; beyond it the memory starts anew.
KNOWN_WORDS = 300_000


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", trained=None, most_rows: int = 20_000) -> Grammar:
    """Fit the insult weights on at most about ``most_rows`` labelled texts, drawn by hash of their id.

    ``trained`` is a condition on the labels' rows. Without labelled texts, or
    with one class only, the grammar is the seed list. Null labels and null texts
    teach nothing. Repeated texts count once.
    """
    sample = bounded_labels(labels, doc_id, label, F.lit(True) if trained is None else trained, most_rows)
    texts = (
        docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("body"))
        .join(F.broadcast(sample), F.col("id") == F.col("train_id"))
        .where(F.col("body").isNotNull())
        .groupBy(F.sha2("body", 256).alias("digest"))
        .agg(F.first("body").alias("body"), F.max("train_label").alias("toxic"))
    )
    words = texts.select("digest", "toxic", F.regexp_extract_all(F.lower("body"), F.lit("(?U)" + WORD_PATTERN), F.lit(0)).alias("w"))
    pairs = words.select("digest", "toxic", F.explode(F.arrays_zip("w", F.concat(F.array(F.lit("")), "w").alias("before"))).alias("p"))
    counts = cut_lineage(
        pairs.groupBy(F.col("p.w").alias("term"), "digest", "toxic")
        .agg(F.min("p.before").alias("before"))
        .groupBy("term")
        .agg(
            F.sum("toxic").cast("double").alias("toxic"), F.count("*").alias("n"),
            F.countDistinct(F.when(F.col("toxic") == 1, F.col("before"))).alias("contexts"),
        )
    )
    # A stem's evidence is its distinct words, each with its share of toxic texts, so no frequent word speaks for its stem;
    # and of the texts that its words are in, as large a share must be toxic.
    stems = counts.select(
        F.explode(F.array(*[F.when(F.length("term") > n, F.substring("term", 1, n)) for n in STEMS])).alias("term"),
        (F.col("toxic") / F.col("n")).alias("share"), "toxic", "n",
    ).where("term IS NOT NULL").groupBy("term").agg(
        F.sum("share").alias("toxic"), F.count("*").alias("n"), (F.sum("toxic") / (F.sum("n") + PRIOR)).alias("of_texts"),
    )
    grammar, (base, rows), vocabulary = Grammar(), texts.agg(F.avg("toxic"), F.count("*")).first(), counts.count()
    if not rows or base in (0.0, 1.0):
        return grammar
    toxic, n = F.col("toxic"), F.col("n")
    share = (toxic + PRIOR * base) / (n + PRIOR)
    ratio = 2 * (toxic * F.log(toxic / (n * base)) + F.coalesce((n - toxic) * F.log((n - toxic) / (n * (1 - base))), F.lit(0.0)))
    # As many words are tried as there are, so the likelihood ratio must exceed what the best of them reaches by chance.
    sure = (toxic > n * base) & (share >= LEAST_SHARE) & (ratio >= 2 * math.log(vocabulary + 1) + 4)
    for row in counts.where(sure & (F.col("contexts") >= CONTEXTS)).select("term", share.alias("share")).collect():
        if row.term not in FRAME:
            grammar.words[row.term] = max(row.share, grammar.words.get(row.term, 0.0))
    for row in stems.where(sure & (F.col("of_texts") >= LEAST_SHARE)).select("term", F.least(share, "of_texts").alias("share")).collect():
        grammar.stems[row.term] = row.share
    stemmed = F.lit(False)
    for n in STEMS:
        known = [x for x in grammar.stems if len(x) == n]
        stemmed = stemmed | ((F.length("term") > n) & F.substring("term", 1, n).isin(known)) if known else stemmed
    grammar.clean = {row.term for row in counts.where(stemmed & (share < LEAST_SHARE)).select("term").collect()}
    return grammar


def score(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``toxic_clauses`` and ``toxic_words``; columns of these names are replaced.

    Every row keeps its place, repeated rows included. A null or empty text
    scores 0. A long text is read whole, clause by clause. No shuffle.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast((grammar.words, grammar.stems, grammar.clean))

    def start():
        own, known, hits = Grammar(*broadcast.value), {}, set()

        def compute(texts):
            if len(known) > KNOWN_WORDS:
                known.clear()
                hits.clear()
            return list(zip(*[own.score(t, known, hits) for t in texts], strict=True)) or [[], [], []]

        return compute

    return with_text_columns(docs, text, FIELDS, start)


def trained_rows(doc_id: str = "doc_id"):
    """The training part: the id's checksum modulo 3 is not 1."""
    return id_crc(F.col(quoted(doc_id))) % 3 != 1
