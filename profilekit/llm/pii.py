"""Sanitising personal data by pattern and by information content, in DataFrame operations alone.

Protected entities are e-mail addresses, IP addresses, card numbers and phone
numbers. Beside them, a term (a word) can give an entity away. From the whole
corpus it is estimated how much: with ``IC(c) = -log p(c)`` the information of
an entity c, and ``PMI(c, t) = log p(c, t) / (p(c) p(t))`` what a term t says
about it, ``PMI / IC`` is 0 for a term that says nothing and 1 for one that is
found only with the entity. Terms above ``GENERALISE`` are replaced by their
kind, terms above ``REMOVE`` are removed.

Probabilities are shares of all texts; a term counts as being with an entity if
it stands near it, so what stands farther off can only lower the estimate. It
must do so in several distinct texts, whose words before the entity or whose
words after it differ, so copies of one text are no evidence. Which words stand
beside the term doesn't matter: a surname that always follows the same first
name is rated like any other. As many pairs are tried as there are, so a pair
must be surer than the best of them is by chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import free_name, without
from profilekit.llm.spans import matches_if
from profilekit.runtime import cut_lineage, hint_if_small, quoted

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Disclosure (PMI / IC) from which a term is generalised or removed.
GENERALISE, REMOVE = 0.5, 0.8
#: Characters on either side of an entity that count as near, distinct texts and surroundings that a term needs with it.
NEAR, LEAST_TEXTS = 300, 3

# The lookbehinds begin a match where a run of its first characters begins, or where
# the match before has ended, which is where the leftmost match begins; so no run is
# tried twice. Possessive quantifiers never give back what the next part can't take.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[\p{L}\p{N}]{3,}"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The checksum of a string of digits: every second one from the right doubled, digits of the result summed."""
    n = F.length(number)
    digit = lambda i: F.substr(number, n - i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(F.pmod(digit(i) * 2, F.lit(10)) + F.floor(digit(i) * 2 / 10).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        number = digits(value)
        return F.length(number).between(14, 19) & F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def gates(text: Column) -> dict[str, Column]:
    """Cheap conditions without which a kind can't occur."""
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds as ``array<struct<start, rank, end, kind, value>>``, sorted by start, then kind as listed."""
    gate = gates(text)

    def of(rank: int, kind: str) -> Column:
        found = F.filter(matches_if(gate[kind], text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(found, lambda m: span(m, rank, kind))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def span(m: Column, rank: int, kind: str) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def rating(n_ct: Column, n_c: Column, n_t: Column, total: int) -> Column:
    """PMI / IC, at least 0; 0 for an entity of every text."""
    n = F.lit(float(total))
    pmi, information = F.log(n_ct * n / (n_c * n_t)), F.log(n / n_c)
    return F.when(information > 0, F.greatest(pmi / information, F.lit(0.0))).otherwise(0.0)


def beyond_chance(n: Column, n_ct: Column, n_c: Column, n_t: Column, total: int, pairs: int) -> Column:
    """Whether ``n`` distinct texts with both are more than chance gives the best of ``pairs`` pairs: a likelihood ratio of Poisson counts."""
    ratio = n_ct * F.lit(float(total)) / (n_c * n_t)
    return (ratio > 1) & (2 * n * (F.log(ratio) - 1 + 1 / ratio) >= 2 * math.log(pairs + 1) + 4)


def near_terms(found: DataFrame) -> DataFrame:
    """``entity``, ``term``, ``n_c``, ``n_ct`` (texts with both) and ``n`` (distinct ones) of the pairs with enough texts and surroundings."""
    # Equal texts are taken once, with their number.
    copies = hint_if_small(cut_lineage(found.groupBy("page").agg(F.count("*").alias("copies"))))
    each = found.select("page", "body", F.explode("base").alias("s"))
    entity = F.xxhash64(F.col("s.kind"), F.lower(F.col("s.value")))
    each = each.select("page", entity.alias("entity"), "body", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    held = each.groupBy("entity", "page").agg(F.count("*").alias("k")).join(copies, "page")
    counted = held.groupBy("entity").agg(F.count("*").alias("n"), F.sum("copies").alias("n_c"))
    recurring = cut_lineage(counted.where(F.col("n") >= LEAST_TEXTS).drop("n"))
    left = F.substring("body", F.greatest(F.col("start") - NEAR, F.lit(0)) + 1, F.least("start", F.lit(NEAR)))
    right = F.substring("body", F.col("end") + 1, F.lit(NEAR))
    near = each.join(hint_if_small(recurring), "entity").select("page", "entity", "n_c", words(left).alias("before"), words(right).alias("after"))
    near = near.select("page", "entity", "n_c", F.xxhash64("before").alias("before"), F.xxhash64("after").alias("after"), F.explode(F.array_distinct(F.concat("before", "after"))).alias("term"))
    # A text that holds an entity several times has one pair of surroundings for each of its terms.
    pairs = near.groupBy("entity", "n_c", "term", "page").agg(F.min("before").alias("before"), F.min("after").alias("after"))
    both = pairs.join(copies, "page").groupBy("entity", "n_c", "term").agg(
        F.count("*").alias("n"), F.sum("copies").alias("n_ct"),
        F.greatest(F.countDistinct("before"), F.countDistinct("after")).alias("contexts"),
    )
    return both.where((F.col("n") >= LEAST_TEXTS) & (F.col("contexts") >= LEAST_TEXTS)).drop("contexts")


def disclosing(docs: DataFrame, text: str = "text", generalise: float = GENERALISE) -> DataFrame:
    """``term`` and ``disclosure`` (0 to 1) of the terms that give an entity away, estimated over all texts."""
    rows = docs.where(F.col(quoted(text)).isNotNull()).select(F.xxhash64(quoted(text)).alias("page"), F.col(quoted(text)).alias("body"))
    found = rows.withColumn("base", base_spans(F.col("body"))).where(F.size("base") > 0)
    candidates = cut_lineage(near_terms(found))
    if candidates.isEmpty():
        return candidates.select("term", F.lit(1.0).alias("disclosure"))
    # All terms are counted, which partial sums make small, and then looked up; frequent ones never become rows of a join.
    counted = rows.select(F.explode(F.array_distinct(words(F.col("body")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts, total = [F.col(c) for c in ("n_ct", "n_c", "n_t")], rows.count()
    rated = candidates.join(counted, "term").where(beyond_chance(F.col("n"), *counts, total, candidates.count()))
    rated = rated.withColumn("disclosure", rating(*counts, total))
    return cut_lineage(rated.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise))


def sanitise(docs: DataFrame, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with ``spans`` (list of all spans), ``n_email`` ... ``n_phone``, ``base_sha256`` and ``clean_text``.

    Columns of these names are replaced, others stay. A null text counts as empty and stays
    null in ``clean_text``. Every row stays, repeated rows included. In
    ``clean_text`` entities become ``[EMAIL]`` and so on, disclosing terms
    ``[NUMBER]``, ``[NAME]`` or ``[WORD]``, or nothing if above ``remove``; of
    overlapping spans the first stands.
    """
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "clean_text"]
    out = without(docs, names)
    columns = out.columns
    own, its_page, base, both = (free_name(docs, n) for n in ("own terms", "terms page", "base spans", "all spans"))
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    terms = disclosing(docs, text, generalise)
    empty = F.array().cast("array<struct<term:string,disclosure:double>>")
    if terms.isEmpty():
        out = out.withColumn(own, empty)
    else:
        pages = docs.where(F.col(quoted(text)).isNotNull()).select(F.xxhash64(quoted(text)).alias("page"), F.explode(F.array_distinct(words(F.col(quoted(text))))).alias("term"))
        held = pages.join(hint_if_small(terms), "term").groupBy("page", "term").agg(F.first("disclosure").alias("disclosure"))
        held = cut_lineage(held.groupBy(F.col("page").alias(its_page)).agg(F.collect_list(F.struct("term", "disclosure")).alias(own)))
        # This table grows with the pages, so it is never broadcast; hot pages are split by AQE.
        out = out.join(held.hint("merge"), F.xxhash64(quoted(text)) == F.col(its_page), "left").withColumn(own, F.coalesce(own, empty))
    any_of = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(own, lambda t: t["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    added = F.transform(matches_if(F.size(own) > 0, body, any_of), lambda m: span(m, len(KINDS), TERM))
    out = out.withColumn(base, base_spans(body)).withColumn(both, F.array_sort(F.concat(base, added)))
    surely = F.filter(own, lambda t: t["disclosure"] >= remove)
    removed = F.transform(surely, lambda t: t["term"])
    kind_of = lambda s: F.when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    put = lambda s: F.when(s["kind"] != TERM, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(F.array_contains(removed, F.lower(s["value"])), "").otherwise(kind_of(s))

    def add(state: Column, s: Column) -> Column:
        gap = F.substr(body, state["pos"] + 1, s["start"] - state["pos"])
        return F.when(s["start"] < state["pos"], state).otherwise(
            F.struct(s["end"].alias("pos"), F.concat(state["out"], F.array(gap, put(s))).alias("out"))
        )

    first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(both, first, add, lambda state: F.concat(F.array_join(state["out"], ""), F.substr(body, state["pos"] + 1, F.length(body))))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        *[F.col(quoted(c)) for c in columns],
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col(base)), 256).alias("base_sha256"),
        listed(F.col(both)).alias("spans"),
        F.when(F.col(quoted(text)).isNotNull(), F.when(F.size(both) == 0, body).otherwise(clean)).alias("clean_text"),
    )
