"""Personal data against plain patterns, and disclosing terms against a plain count of the corpus."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import disclosure
from catalog_engine.llm.queries import QUERIES
from tests.llm.test_operators import plain_plan

ROOT = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain_personal(text: str | None) -> dict[str, list[tuple[int, int]]]:
    def holds(kind, value):
        number = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 16 <= len(number) <= 19 and luhn(number)
        return kind == "email" or 8 <= len(number) <= 15

    return {k: [m.span() for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in PLAIN.items()}


def plain_digest(found) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans).encode()).hexdigest()


def test_query_finds_what_plain_patterns_find(spark):
    found = QUERIES["op11_personal_data"](spark, ROOT)
    assert plain_plan(found)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(docs) and sum(len(r["spans"]) > 0 for r in rows) >= 40
    for r in rows:
        want = plain_personal(docs[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(map(len, want.values()))
        assert r["base_sha256"] == plain_digest(want)


TRICKY = [
    "a@b.com_x@d.org a@b..c@d.com x@y@z.com aa@bb a@b.c-d.e.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3 999.1.2.3.4 1.1.1.1.", "é 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 1234 4111  1111 1111 1111",
    "0" * 16 + " " + "0" * 30 + " x " + "0" * 19, "+1 (743) 555-3824. +12 +1234567 +12345678-- +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6 ++44 20 7946 0958)", "\U0001f600 a@b.de \U0001f600\n1.2.3.4\U0001f600+4930123456\r\n",
    "a@b" + ".c" * 20_000, "a@" * 2_000, "q@r.st " * 3_000, "1.1.1.1 " * 3_000 + "+" * 2_000, "", None, " \n",
]
#: nothing to find, and quadratic for patterns that look again from every place
LONG = ["x" * 300_000 + "@", "1" * 300_000, "+1" + " " * 300_000, "a@" * 150_000, "1." * 2 + "9" * 300_000, "x" * 300_000]


def test_long_texts_without_a_match(spark):
    frame = spark.createDataFrame(list(enumerate(LONG)), "k int, text string").repartition(6)
    rows = frame.select(*[F.size(c).alias(k) for k, c in disclosure.personal_spans(F.col("text")).items()]).collect()
    assert all(set(r) == {0} for r in rows) and len(rows) == len(LONG)


def test_patterns_on_hard_texts(spark):
    frame = spark.createDataFrame(list(enumerate(TRICKY)), "k int, text string")
    rows = frame.select("k", *[c.alias(k) for k, c in disclosure.personal_spans(F.coalesce("text", F.lit(""))).items()]).collect()
    for r in rows:
        want = plain_personal(TRICKY[r["k"]])
        for kind in disclosure.KINDS:
            assert [(s["start"], s["stop"]) for s in r[kind]] == want[kind], (r["k"], kind)
            assert all(s["value"] == TRICKY[r["k"]][s["start"] : s["stop"]] for s in r[kind][:50])


def test_random_texts(spark):
    random = np.random.default_rng(5)
    signs = list("0123456789" * 3 + "ab@..--+ () _%é\n")
    texts = ["".join(random.choice(signs, int(random.integers(1, 90)))) for _ in range(3_000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(6)
    rows = frame.select("k", *[F.transform(c, lambda s: F.concat_ws(":", s["start"], s["stop"])).alias(k) for k, c in disclosure.personal_spans(F.col("text")).items()]).collect()
    for r in rows:
        want = plain_personal(texts[r["k"]])
        assert {k: r[k] for k in disclosure.KINDS} == {k: [f"{a}:{b}" for a, b in spans] for k, spans in want.items()}


def corpus() -> list[str]:
    random = np.random.default_rng(6)
    common = [f"word{chr(97 + k)}" for k in range(26)]
    text = lambda n: " ".join(str(w) for w in random.choice(common, n))
    out = [text(40) for _ in range(300)]
    # a name that stands near the address in different surroundings, and elsewhere without it
    out += [f"{text(9)} Zebulon {text(3)} zeb@quux.org {text(9)}" for _ in range(6)]
    out += [f"Yesterday {text(5)} ZEBULON {text(5)}"]
    # a nickname of a number that is often seen alone, and a number with words that are copied with it
    out += [f"{text(5)} bluebird {text(2)} +44 20 7946 0958 {text(5)}" for _ in range(4)] + [f"{text(5)} bluebird {text(7)}" for _ in range(12)]
    out += [f"the copied Marmalade story 192.168.7.9 of Hollyhock {k}" for k in range(40)] * 2
    return out + [None, ""]


def plain_terms(texts: list[str | None], contexts: int) -> dict[str, float]:
    whole = [t or "" for t in texts]
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", re.sub(r"\S*@\S*", " ", t.lower()))]
    good = lambda ws: [w for w in ws if len(w) >= 3 and re.search("[a-z]", w)]
    holding, near, around, texts_of = {}, {}, {}, {}
    for k, t in enumerate(whole):
        for kind, spans in plain_personal(t).items():
            for a, b in spans:
                value = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub("[^0-9]", "", t[a:b])
                side = (*good(words(t[:a]))[-6:], *good(words(t[b:]))[:6])
                holding.setdefault((kind, value), set()).add(k)
                for w in side:
                    near.setdefault((kind, value, w), set()).add(k)
                    texts_of.setdefault((kind, value, w), set()).add(t)
                    around.setdefault((kind, value, w), set()).add(side)
    seen = {}
    for k, t in enumerate(whole):
        for w in set(words(t)):
            seen.setdefault(w, set()).add(k)
    out = {}
    for (kind, value, w), ks in near.items():
        if len(texts_of[kind, value, w]) >= contexts and len(around[kind, value, w]) >= contexts:
            c = len(holding[kind, value])
            out[w] = max(out.get(w, -9), math.log(len(ks) * len(whole) / (c * len(seen[w]))) / math.log(len(whole) / c))
    return out


def test_terms_that_disclose(spark):
    texts = corpus()
    frame = spark.createDataFrame([(k, t, "x", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, term string, share double").repartition(5)
    terms = disclosure.disclosing_terms(frame.select(F.coalesce("text", F.lit("")).alias("text")), contexts=3, share=-9.0)
    want = plain_terms(texts, 3)
    assert {r["term"]: pytest.approx(r["share"]) for r in terms.collect()} == want
    assert want["zebulon"] >= disclosure.REMOVE and 0.3 < want["bluebird"] < disclosure.GENERALISE and "marmalade" not in want
    rows = disclosure.find_personal(frame, keep=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        shown = [text[s["start"] : s["stop"]] for s in r["term"]]
        assert shown == re.findall("(?i)zebulon", text) and all(s["label"] == "" for s in r["term"])
        assert not re.search("(?i)zebulon|quux|7946|192.168", r["sanitised"]) and (shown or r["email"] or r["ip"] or r["phone"] or r["sanitised"] == text)
    softer = disclosure.find_personal(frame, share=0.3).filter("doc_id >= 307").collect()
    assert any("[term]" in r["sanitised"] for r in softer) and not any("bluebird" in r["sanitised"] for r in softer)


def test_odd_documents(spark, odd_docs, empty_docs):
    rows = disclosure.find_personal(odd_docs, keep=["doc_id", "text", "score"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = plain_personal(r["text"])
        assert {k: [(s["start"], s["stop"]) for s in r[k]] for k in want} == want and r["term"] == []
    assert disclosure.find_personal(empty_docs).count() == 0


def test_running_totals(spark):
    for n in (0, 1, 2, 255, 256, 257, 2_000):
        row = spark.range(1).select(disclosure.running_totals(F.expr(f"transform(slice(sequence(0, {n}), 1, {n}), x -> cast(x * 3 as bigint))")).alias("t")).first()
        assert row["t"] == [3 * k * (k - 1) // 2 for k in range(n)]


def test_no_text_is_shuffled_for_the_terms_it_holds(spark):
    """Terms looked up inside the row and terms joined by the digest of the text are the same."""
    texts = ["Zebulon met marmalade, ZEBULON", "marmalade", "nothing", "", "a@zebulon.org zebu lon", "zebulon"]
    whole = spark.createDataFrame([(k, t, hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(texts)], "row int, text string, digest string").repartition(3)
    terms = spark.createDataFrame([("zebulon", 0.9), ("marmalade", 0.75), ("hollyhock", 0.8)], "term string, share double")
    inside, joined = disclosure.with_leaks(whole, terms), disclosure.with_leaks(whole, terms, in_row=2)
    listed = lambda rows: {r["row"]: [tuple(s) for s in r["leaks"] or []] for r in rows.collect()}
    want = {0: [("marmalade", 0.75), ("zebulon", 0.9)], 1: [("marmalade", 0.75)], 2: [], 3: [], 4: [], 5: [("zebulon", 0.9)]}
    assert listed(inside) == listed(joined) == want
    plan = inside._jdf.queryExecution().optimizedPlan()
    assert all(node not in line for line in plan.toString().splitlines() if not line.lstrip().startswith(":") for node in ("Join", "Aggregate"))


def test_words_are_counted_before_they_meet_the_terms(spark):
    """A common word that is a candidate costs the join one row, not one a text."""
    texts = [f"common word{k % 7} {k} a@b.org shared more{k % 5}" for k in range(400)] + ["common shared"] * 600
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    plans = []
    real = disclosure.staged
    try:
        disclosure.staged = lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, label)
        disclosure.disclosing_terms(frame, share=-9.0)
    finally:
        disclosure.staged = real
    assert not any("LeftSemi" in plan for label, plan in plans if label == "terms")
