"""Personal data, licences and site lines against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilekit.llm import licences, linededup, pii, queries
from profilekit.llm.licences import PHRASES
from corpus_fixtures import documents, odd  # noqa: F401

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def naive_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            number = re.sub(r"\D", "", m[0])
            fine = {
                "email": lambda m: True,
                "ip": lambda m: all(len(x) < 99 and int(x) <= 255 for x in m[0].split(".")),
                "card": lambda m: 14 <= len(number) <= 19 and luhn(number),
                "phone": lambda m: 10 <= len(number) <= 15,
            }[kind](m)
            if fine:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


TRICKY = [
    "a@b.cd@e.fg a@b.c_x@d.e @x.y a@b a@b. a@b.c.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 12345678901.2.3.4", "😀 4111 1111 1111 1111 x 4111-1111-1111-1112 4111111111111111",
    "+1 (555) 123-4567 +49 30 1234567890123456 ++1 5551234567 +1-", "4111 1111 1111 1111+1 555 123 4567 10.0.0.1@x.com", "é@ü.de e.e@e-e.e-e", "5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5", "1" * 5000, "a" * 5000 + "@" + "b." * 3000 + "c",
]


def held_spans(df):
    return {r.doc_id: r for r in df.collect()}


def test_base_spans_equal_the_plain_patterns(documents):
    got = held_spans(pii.sanitise(documents(*TRICKY)))
    for i, text in enumerate(TRICKY):
        want = naive_spans(text)
        assert got[i].spans == ",".join(want)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(s.startswith(kind) for s in want)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("a@.1+5-( )é4x\n", max_size=60), min_size=30, max_size=30))
def test_base_spans_on_any_text(documents, texts):
    got = held_spans(pii.sanitise(documents(*texts)))
    assert [got[i].spans for i in range(len(texts))] == [",".join(naive_spans(t)) for t in texts]


def test_terms_that_give_an_entity_away(documents):
    names = "anna bernd clara dora emil frida".split()
    rows = [f"chief {w} zebraman writes to boss@corp.example today {w} project {i}" for i, w in enumerate(names)]
    rows += [f"plain text {w} chief project today number {i} writes" for i, w in enumerate(names * 20)]
    rows += ["copied copytext words with one@only.example here"] * 9
    out = held_spans(pii.sanitise(documents(*rows)))
    assert [s.split(":")[0] for s in out[0].spans.split(",")].count("term") >= 1
    text = rows[0]
    marked = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in out[0].spans.split(",")]
    assert "boss@corp.example" in marked and "today" not in marked and "chief" not in marked
    assert "zebraman" not in out[0].clean_text and "[EMAIL]" in out[0].clean_text
    assert "term" not in out[len(rows) - 1].spans  # copies of one text are no evidence
    assert out[50].clean_text == rows[50]


def test_terms_are_rated_whatever_stands_beside_them(documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=3))
    prose = lambda: " ".join(word() for _ in range(30))
    rows = [f"{prose()}\nMaria Kowalczyk, maria@x.com\n{prose()}" for _ in range(60)]
    rows += [f"{prose()} 10.1.1.{i}" for i in range(400)]
    out = held_spans(pii.sanitise(documents(*rows)))
    for i in range(60):
        assert "Maria" not in out[i].clean_text and "Kowalczyk" not in out[i].clean_text and "[EMAIL]" in out[i].clean_text
    assert all("term" not in out[i].spans for i in range(60, 460))


def naive_disclosing(texts):
    """Disclosure of each term by plain counts."""
    spot = {"entity": defaultdict(set), "term": defaultdict(set)}
    near = defaultdict(dict)
    words = lambda t: re.findall(r"[^\W_]{3,}", t.lower())
    for d, text in enumerate(texts):
        for w in words(text):
            spot["term"][w].add(d)
        for s in naive_spans(text):
            kind, start, end = s.split(":")
            start, end = int(start), int(end)
            entity = (kind, text[start:end].lower())
            spot["entity"][entity].add(d)
            before, after = words(text[max(0, start - pii.NEAR) : start]), words(text[end : end + pii.NEAR])
            for w in {*before, *after}:
                near[entity, w].setdefault(d, (tuple(before), tuple(after)))
    tried = {
        pair: held for pair, held in near.items()
        if len({texts[d] for d in held}) >= pii.LEAST_TEXTS and max(len({x[k] for x in held.values()}) for k in (0, 1)) >= pii.LEAST_TEXTS
    }
    out = defaultdict(float)
    for (entity, w), held in tried.items():
        n_c, n_t, n = len(spot["entity"][entity]), len(spot["term"][w]), len(texts)
        ratio = len(held) * n / (n_c * n_t)
        surprise = 2 * len({texts[d] for d in held}) * (math.log(ratio) - 1 + 1 / ratio)
        if ratio > 1 and surprise >= 2 * math.log(len(tried) + 1) + 4:
            out[w] = max(out[w], math.log(ratio) / math.log(n / n_c))
    return {w: x for w, x in out.items() if x >= pii.GENERALISE}


def test_disclosure_equals_plain_counts(documents):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnpr"]
    people = [(f"first{i % 5}x", f"last{i}y", f"p{i}@mail.example") for i in range(12)]
    texts = []
    for i in range(240):
        first, last, address = people[rng.randrange(12)]
        prose = " ".join(rng.choices(vocabulary, k=20))
        texts.append(f"{prose} {first} {last} {address} {rng.choice(vocabulary)}" if i % 3 == 0 else f"{prose} {first if i % 3 == 1 else ''}")
    texts += ["only copies beside once@mail.example here"] * 7 + [texts[0]] * 5
    got = {r.term: r.disclosure for r in pii.disclosing(documents(*texts)).collect()}
    want = naive_disclosing(texts)
    assert got == pytest.approx(want) and sum(w.startswith("last") for w in want) >= 8 and "copies" not in want


def test_columns_of_the_work_stay(documents):
    docs = documents("licensed under the apache license, version 2.0", "a@b.cc and more\nFooter")
    for op, names in (
        (licences.scan, ["places", "its words", "low text", "found"]), (pii.sanitise, ["own terms", "base spans", "All Spans", "terms page"]),
        (linededup.drop_boilerplate, ["join keys", "join lines", "join site"]),
    ):
        own = docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
        rows = op(own).collect()
        assert all(r[n] == f"mine {n}" for r in rows for n in names)


@pytest.mark.parametrize("op", [pii.sanitise, licences.scan, linededup.drop_boilerplate])
def test_odd_texts_clashing_columns_and_empty_tables(documents, odd, op):
    docs = odd.withColumn("spans", F.lit(1)).withColumn("labels", F.lit("own")).withColumn("n_dropped", F.lit("x"))
    out = op(docs).collect()
    assert len(out) == odd.count()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in odd.collect())
    assert op(documents()).count() == 0
    null = next(r for r in out if r.doc_id == 0)
    assert null.text is None


def naive_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return words, places


def test_base_phrases_equal_plain_search(spark, documents):
    texts = ["CC BY cc-by cc by", "Apache\nLicense apache license MIT_license", "gnu General public license " * 3, "mit licenses cc é by", "license", "ÀPACHE license"]
    docs = documents(*texts).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000))
    text_of = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in licences.scan(docs).collect():
        words, places = naive_phrases(text_of[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_contained_detections_are_suppressed(documents):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "released under the terms of the GNU Lesser General Public License v2.1 or later",
        "SPDX-License-Identifier: MPL-2.0", "under CC BY-NC 4.0", "This is not about terms.", "mit license, bsd license and MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ]
    got = {r.doc_id: r for r in licences.scan(documents(*texts)).collect()}
    assert [d.label for d in got[0].detections] == ["apache-2.0"] and (got[0].detections[0].start, got[0].detections[0].end) == (0, 46)
    assert [d.label for d in got[1].detections] == ["lgpl-2.1"]
    assert got[2].labels == "mpl-2.0" and got[3].labels == "cc-by,cc-by-nc-4.0" and got[4].labels == ""
    assert got[5].labels == "bsd,mit" and len(got[5].detections) == 3 and got[6].labels == "mit"
    assert len(licences.rules()) > 300


def test_wrapped_notices_are_found_like_others(documents):
    plain = [
        "Redistribution and use in source and binary forms, with or without modification", "GNU General Public License version 2",
        "licensed under the Apache License, Version 2.0", "This program is free software; you can redistribute it", "CC BY-SA 4.0",
        "released into the public domain", "SPDX-License-Identifier: MPL-2.0",
    ]
    marks = ["\n", "\r\n", "  ", "\n# ", "\n *\n * ", "\t// \n// "]
    texts = [t.replace(" ", m) for t in plain for m in [" ", *marks]]
    got = {r.doc_id: r for r in licences.scan(documents(*texts)).collect()}
    for i, text in enumerate(texts):
        first = got[i - i % (1 + len(marks))]
        assert first.score > 0.5 and got[i].labels == first.labels and got[i].score == first.score
        assert [(d.label, text[d.start : d.end].split()) for d in got[i].detections] and got[i].detections[0].start == 0


def naive_standing(found):
    inside = lambda c, d: c[0] <= d[0] and c[1] >= d[1] and ((c[0], c[1]) != (d[0], d[1]) or c[2] < d[2])
    kept = []
    for d in sorted(found, key=lambda d: (sum(inside(c, d) for c in found), d[2], d[0])):
        if all(k[0] >= d[1] or d[0] >= k[1] for k in kept):
            kept.append(d)
    return sorted(kept)


def test_detections_are_suppressed_only_by_those_that_stand(spark):
    rng = random.Random(5)
    sets = [[(0, 10, 3), (5, 20, 2), (15, 30, 1), (2, 4, 9), (21, 22, 8)]]
    sets += [[(s, s + rng.randint(1, 12), p) for p, s in enumerate(rng.choices(range(40), k=rng.randrange(12)))] for _ in range(60)]
    rows = [(i, [(s, -e, p, "x", 0.5) for s, e, p in found]) for i, found in enumerate(sets)]
    table = spark.createDataFrame(rows, f"i int, found {licences.DETECTIONS}")
    for r in table.select("i", licences.standing(F.col("found")).alias("kept")).collect():
        assert [(d.start, -d.neg_end, d.priority) for d in r.kept] == naive_standing(sets[r.i])
    # The middle one goes for the last, so what it alone had met comes back.
    assert naive_standing(sets[0]) == [(0, 10, 3), (15, 30, 1)]


def naive_lines(rows):
    """(site, text) rows to their new texts."""
    pages = defaultdict(set)
    for site, text in rows:
        pages[site].add(text)
    bad = defaultdict(set)
    for site, texts in pages.items():
        held = Counter(line for t in texts for line in {x.strip(linededup.WHITE) for x in (t or "").split("\n")} if line)
        bad[site] = {x for x, n in held.items() if n >= linededup.LEAST_PAGES and n / len(texts) > linededup.MOST_RATIO}
    out = []
    for site, text in rows:
        kept = "\n".join(x for x in (text or "").split("\n") if not x.strip(linededup.WHITE) or x.strip(linededup.WHITE) not in bad[site])
        out.append(None if text is None else kept)
    return out


def test_site_lines_equal_plain_counts(documents):
    rows = [(f"s{i % 3}" if i % 7 else None, f"Own line number {i} with a few words\n Menu \n\nBody of page {i} goes on" + "\nFooter" * (i % 2)) for i in range(120)]
    rows += [("s1", "one\ntwo\nthree")] * 40 + [("s2", "Menu\nFooter"), ("lonely", "Menu"), ("s1", None)]
    docs = documents(*[(i, text, site) for i, (site, text) in enumerate(rows)])
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(docs).collect()}
    assert [got[i] for i in range(len(rows))] == naive_lines(rows)
    assert "Menu" not in got[1] and got[125] == "one\ntwo\nthree"


def test_thin_pages_and_crlf(documents):
    rows = [("s", f"HEADER LINE\r\nown {i}\r\n\r\nFOOTER\t\r\n") for i in range(21)]
    got = [r.text for r in linededup.drop_boilerplate(documents(*[(i, t, s) for i, (s, t) in enumerate(rows)])).orderBy("doc_id").collect()]
    assert got == [f"own {i}\r\n\r\n" for i in range(21)]


def test_site_lines_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.ORACLES["op9_site_lines"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES["op9_site_lines"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()


def test_hosts(spark):
    rows = spark.createDataFrame([("HTTP://A.Example.com/x?y",), ("not a url",), (None,)], "u string")
    assert [r[0] for r in rows.select(linededup.host_of(F.col("u"))).collect()] == ["a.example.com", None, None]
