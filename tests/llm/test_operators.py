"""Operators against brute force, public libraries or held-out rows, with odd and empty tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalog_engine.llm import bytepairs, hosts, language, licences, packing, quality, rules, simhash, substrings, topk
from catalog_engine.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.oracle import compare, connect

ROOT = "/root/testdata/sf0.001"


def plain_plan(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# --- language and quality


def test_codewords_differ_in_many_bits():
    for classes in (2, 3, 4, 5, 9, 30):
        code = language.codewords(classes)
        apart = min(int((a != b).sum()) for k, a in enumerate(code) for b in code[:k])
        assert len(code) == classes and apart >= (1 if classes == 2 else 2 if classes < 5 else 4)


def test_language_of_held_out_documents(spark):
    found = QUERIES["op1_language_id"](spark, ROOT)
    truth = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "lang")
    rows = found.filter("held_out").join(truth, "doc_id").collect()
    assert rows and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_documents(odd_docs, empty_docs):
    model = language.fit_languages(odd_docs)
    rows = language.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            lettered = texts[r["doc_id"]] and any(c.isalpha() for c in texts[r["doc_id"]])
            assert (r["lang_pred"] in ("de", "en")) if lettered else (r["lang_pred"] == "und" and r["score"] == 0)
    nothing = language.fit_languages(empty_docs)
    assert language.identify(empty_docs, nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs, nothing).collect()} == {"und"}
    assert language.identify(empty_docs, model).count() == 0


def test_equal_losses_are_flagged_as_ambiguous():
    code = language.codewords(3)
    best, first, second = language.decode(np.zeros((1, code.shape[1])), code)
    assert best[0] == 0 and np.isclose(first[0], second[0])


def test_quality_of_held_out_documents(spark):
    root = "/root/testdata/sf0.01"
    found = QUERIES["op2_quality_classifier"](spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r["predicted"] for r in found if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.3


def test_quality_of_odd_documents(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(1, 0), (7, 1), (7, 1), (8, 1), (None, 1), (9, None), (15, 0)], "doc_id long, quality int")
    model = quality.fit_quality(odd_docs, labels, F.lit(True))
    rows = quality.score_quality(odd_docs, model).collect()
    scores = {}
    for r in rows:
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len(scores[7]) == 1 and scores[7] == scores[8] and scores[0] == scores[1] == scores[2]
    assert quality.score_quality(empty_docs, quality.fit_quality(empty_docs, labels, F.lit(True))).count() == 0


def test_long_texts_are_worked_on_in_blocks(spark, monkeypatch):
    import pyarrow as pa

    random = np.random.default_rng(8)
    texts = [None, "", "x" * 500, "Ab c, 12 " * 90, " ".join(random.choice(["Alpha", "beta", "7", "!?", "\n"], 400))]
    words = random.normal(size=(quality.BUCKETS, 2 * quality.DIM)).astype(np.float32)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = quality.words_of(pa.array(texts)), quality.pooled(pa.array(texts), words), quality.word_vectors(docs)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 64)
    monkeypatch.setattr(quality, "BLOCK_WORDS", 16)
    blocks = quality.words_of(pa.array(texts)), quality.pooled(pa.array(texts), words), quality.word_vectors(docs)
    assert all(np.array_equal(a, b) for a, b in zip(whole[0], blocks[0]))
    assert np.allclose(whole[1], blocks[1], atol=1e-6) and np.array_equal(whole[2], blocks[2])
    bucket, row, _ = whole[0]
    for k in range(len(texts)):
        own = words[bucket[row == k]].astype(np.float64)
        if len(own):
            assert np.allclose(whole[1][k, : 2 * quality.DIM], own.mean(axis=0), atol=1e-5)
            assert np.allclose(whole[1][k, 2 * quality.DIM : -1], own.std(axis=0), atol=1e-5)


def test_rows_that_repeat_a_key_do_not_lengthen_the_sample(spark, monkeypatch):
    rows = [(k, f"plain words of text number {k} stand here " * (8 if k % 2 else 1)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once, often = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, rows + [rows[3]] * 300))
    sizes = []
    monkeypatch.setattr(quality, "train_network", lambda inputs, truth: sizes.append((len(inputs), int(truth.sum()))))
    monkeypatch.setattr(rules, "learn_rules", lambda sample: sizes.append((len(sample), sum(1 - r["bad"] for r in sample))))
    for docs in (once, often):
        quality.fit_quality(docs, labels, F.lit(True))
        rules.fit_rules(docs, labels)
    assert sizes == [(40, 20)] * 4


def test_words_are_told_apart_by_letters_and_capitals():
    import pyarrow as pa

    word, row, rows = quality.words_of(pa.array(["the The THE the!! 12", None, "", "the"]))
    assert rows == 4 and word[0] == word[1] == word[3] == word[-1] and word[2] != word[0] and list(row) == [0] * 6 + [3]


# --- top k


def test_top_k_query_agrees_with_sql(spark):
    rows, problem = compare(QUERIES["op3_exact_top_k"](spark, ROOT), connect(ROOT), ORACLES["op3_exact_top_k"])
    assert rows and problem is None, problem


def test_top_k_with_ties_gaps_and_other_lengths(spark):
    random = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in random.normal(0, 1, (90, 6))]
    table = {k: vectors[k % 30] if k < 60 else vectors[k] for k in range(90)}  # many equal vectors
    table |= {200: None, 201: [1.0, None, 0.0, 0.0, 0.0, 0.0], 202: [float("nan")] * 6, 203: [float("inf")] * 6, 204: [1.0, 2.0], 205: [3.0, 1.0], 300: [0.0] * 6}
    rows = [(k, v, 0) for k, v in table.items()] + [(None, vectors[0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = topk.top_k(frame, F.col("vec_id") % 10 == 4, k=7, bins=16, query_rows=3, block_rows=11, spread=3)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = {k: np.floor(1024 * np.array(v)).astype(int) for k, v in table.items() if v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in whole:
        if q % 10 == 4:
            order = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))
            want[q] = {n: (k, -s) for n, (s, k) in enumerate(order[:7], 1)}
    assert got == want and len(got[204]) == 1
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 4).count() == 0


# --- tokens


def test_byte_pairs_agree_with_the_library(spark, odd_docs, empty_docs):
    ranks = bytepairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bytepairs.decode(bytepairs.encode(odd_docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "text"]), ranks)
    rows = coded.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bytepairs.encode(empty_docs, ranks, public_tokenizers.PATTERN).count() == 0


def test_long_words_merge_like_short_ones():
    ranks = bytepairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    table, random = bytepairs.PairTable(ranks), np.random.default_rng(2)
    for letters in ("ab", "the", "ainer", "aé"):
        word = "".join(random.choice(list(letters), 500)).encode()
        one = bytepairs.merge_long(table.single[np.frombuffer(word, dtype=np.uint8)], table)
        other = bytepairs.merge_rows(table.single[np.frombuffer(word, dtype=np.uint8)][None, :].copy(), table)[0]
        assert one.tolist() == other.tolist()


def test_packing_holds_every_id_once(odd_docs, empty_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, path).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc, by_window = {}, {}
    for r in sorted(rows, key=lambda r: (r["start"], r["offset"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, held in by_doc.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in held), dtype="<u4").tolist() == ids
        assert {r["doc_tokens"] for r in held} == {len(ids)} and held[0]["start"] == 0
    for held in by_window.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [sum(x["length"] for x in held[:k]) for k in range(len(held))]
        total = sum(r["length"] for r in held)
        assert total == 4096 or total & (total - 1) == 0
    assert packing.pack(odd_docs, path).groupBy().agg(F.sum("length")).first()[0] > sum(r["length"] for r in rows)
    assert packing.pack(empty_docs, path).count() == 0


def test_level_leaves_least_sum_of_squares():
    windows, random = packing.Windows(64), np.random.default_rng(4)
    for _ in range(400):
        length = int(random.integers(1, 64))
        level = windows.level_for(length)

        def after(h, length=length):
            count = windows.count.copy()
            count[h] -= h > 0
            count[h + length] += h + length < 64
            return (count * count).sum()

        choices = [h for h in range(64 - length + 1) if h == 0 or windows.count[h]]
        assert level in choices and after(level) == min(map(after, choices))
        windows.place((0, 0, b"\0" * 4 * length, length))


# --- rules, hosts, licences


def plain_statistics(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    met = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if met[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_agree_with_plain_python(spark, odd_docs, empty_docs):
    found = rules.with_statistics(odd_docs.drop("n_words"))
    for r in found.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_statistics(r["text"])
    assert rules.judge(empty_docs, []).count() == 0
    judged = rules.judge(odd_docs, [([("mean_word", ">", 100.0)], 0.99)])
    assert plain_plan(judged)
    verdicts = {r["doc_id"]: (r["base_failed"], r["rule"], r["kept"]) for r in judged.collect()}
    assert verdicts[0] == (True, 0, False) and verdicts[11] == (True, 1, False) and verdicts[17] == (False, 0, True)


def test_rules_cover_what_is_bad():
    random = np.random.default_rng(6)
    rows = [{name: float(x) for name, x in zip(rules.FEATURES, random.random(len(rules.FEATURES)))} for _ in range(900)]
    for r in rows:
        r["bad"] = int((r["symbol_share"] > 0.8 and r["mean_word"] <= 0.5) or r["capital_share"] > 0.9)
    learned = rules.learn_rules(rows)
    wrong = sum(any(rules.holds(r, rule) for rule, _ in learned) != r["bad"] for r in rows)
    assert 2 <= len(learned) <= 6 and wrong <= 20
    assert rules.learn_rules([]) == [] and rules.learn_rules([r | {"bad": 0} for r in rows]) == []


def test_rules_query_on_the_tables(spark):
    found = QUERIES["op5_quality_rules"](spark, ROOT)
    assert plain_plan(found)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


URLS = {
    "http://a.net/x": ("a.net", "/x", "net/", "block"),
    "http://Example.NET/en/1?q#h": ("example.net", "/en/1", "example.net/en/", "allow"),
    "https://b.example.net/en": ("b.example.net", "/en", "net/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "http://x.example.com/de/?u=http://q": ("x.example.com", "/de/", "example.com/de/", "block"),
    "http://y.org/fr/\nz": ("y.org", "/fr/\nz", "org/fr/", "allow"),
    "//y.org/fr/": ("", "", None, "allow"),
    "http://net": ("net", "", None, "allow"),
    "x://É.org?/fr/": ("É.org", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(URLS)] + [(None, None, "<a href=", "y")], "page_id long, url string, html string, host string")
    found = hosts.filter_urls(pages, URL_RULES)
    assert plain_plan(found)
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert [rows[k] for k in range(len(URLS))] == list(URLS.values())
    assert hosts.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_distrust_goes_to_those_who_link_to_blocked_hosts(spark):
    link = lambda *targets: " ".join(f"<a href='http://{t}/'>x</a>" for t in targets)
    rows = [("http://bad.net/", ""), ("http://farm.com/", link("bad.net", "Bad.net")), ("http://far.com/", link("farm.com")), ("http://good.org/fr/", link("friend.com")), ("http://friend.com/", link("good.org")), ("http://alone.com/", "<a href='/local'>x</a>")]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    verdict = {r["host"]: r["verdict"] for r in hosts.filter_urls(pages, URL_RULES).collect()}
    assert verdict == {"bad.net": "block", "farm.com": "block", "far.com": "block", "good.org": "allow", "friend.com": "allow", "alone.com": "allow"}


def test_ranks_agree_with_a_plain_loop(spark):
    random = np.random.default_rng(8)
    names = [f"h{k}" for k in range(12)]
    edges = {(a, b): int(random.integers(1, 5)) for a, b in random.integers(0, 12, (40, 2)) if a != b}
    seeds = {names[k]: (float(k == 0), float(k in (5, 7)) / 2) for k in range(12)}
    trust, distrust = (np.array([seeds[n][k] for n in names]) for k in (0, 1))
    start, weights = (trust, distrust), np.zeros((12, 12))
    for (a, b), n in edges.items():
        weights[a, b] = n
    out, into = weights.sum(axis=1, keepdims=True), weights.sum(axis=0, keepdims=True)
    ahead, back = np.divide(weights, out, where=out > 0, out=np.zeros((12, 12))), np.divide(weights, into, where=into > 0, out=np.zeros((12, 12)))
    for _ in range(5):
        trust, distrust = 0.15 * start[0] + 0.85 * ahead.T @ trust, 0.15 * start[1] + 0.85 * back @ distrust
    links = spark.createDataFrame([(names[a], names[b], n) for (a, b), n in edges.items()], "src string, dst string, n long")
    found = hosts.propagate(links, spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), rounds=5)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in found.collect()}
    assert all(np.allclose(got[n], (trust[k], distrust[k])) for k, n in enumerate(names))


def test_licences(spark, odd_docs, empty_docs):
    texts = {
        "Before.\nReleased under the MIT License.\nAfter": ["MIT"],
        "x. Licensed under the Apache License, Version 2.0. y Licensed under CC BY-NC 4.0.": ["Apache-2.0"],
        "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.": ["CC-BY-NC", "GPL-3.0"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.": ["BSD-2-Clause"],
        "SPDX-License-Identifier: MIT": ["MIT"],
        "// SPDX-License-Identifier: Apache-2.0\nReleased under the MIT license": ["MIT"],
        "we license nothing": [],
    }
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, licences string")
    found = licences.scan_licences(frame)
    assert plain_plan(found)
    rows = {r["doc_id"]: r["licences"] for r in found.collect()}
    assert [rows[k] for k in (0, 2, 3, 4, 6)] == [list(texts.values())[k] for k in (0, 2, 3, 4, 6)]
    assert rows[1] == ["Apache-2.0"] and rows[5][-1] == "MIT"
    odd = licences.scan_licences(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r["n_licences"] == 0 for r in odd) and licences.scan_licences(empty_docs).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_licence_lines_of_the_tables(spark, sf):
    root = f"/root/testdata/{sf}"
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    for r in QUERIES["op8_licences"](spark, root).collect():
        want = sorted(name for name, line in lines.items() for x in texts[r["doc_id"]].split("\n") if x == line)
        assert sorted(r["licences"]) == want


# --- duplicates


def plain_fingerprint(text: str | None) -> int:
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(words: list[int], distance: int = 3) -> list[int]:
    label, array = list(range(len(words))), np.array(words, dtype=np.uint64)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in range(len(words)):
        for j in np.flatnonzero(np.bitwise_count(array[:k] ^ array[k]) <= distance):
            a, b = sorted((root(k), root(int(j))))
            label[b] = a
    return [root(k) for k in range(len(words))]


def test_simhash_of_odd_documents(odd_docs, empty_docs):
    marked = simhash.fingerprints(odd_docs)
    rows = marked.join(simhash.near_classes(marked), "fp").collect()
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd_docs.collect()]
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in rows) == Counter(docs)
    words = sorted({w for _, w in docs})
    root = dict(zip(words, plain_components(words)))
    least = {}
    for doc, word in docs:
        if doc is not None:
            least[root[word]] = min(doc, least.get(root[word], doc))
    assert all(r["component_id"] == least.get(root[r["fp"] & (1 << 64) - 1]) for r in rows)
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())
    assert simhash.keep_first(empty_docs).count() == 0


@pytest.mark.parametrize("shard_rows", [60, 100_000])
def test_trees_find_every_link(spark, shard_rows):
    random = np.random.default_rng(9)
    words = [int(w) for w in random.integers(0, 1 << 63, 900)]
    for _ in range(1500):
        word = words[int(random.integers(0, len(words)))] if random.random() < 0.7 else words[0]
        for bit in random.integers(0, 64, int(random.integers(1, 4))):
            word ^= 1 << int(bit)
        words.append(word)
    words = sorted(set(words))
    frame = spark.createDataFrame([(int(np.uint64(w).view(np.int64)),) for w in words], "fp long")
    edges = simhash.linked_words(frame, sample=300, leaf=8, shard_rows=shard_rows).collect()
    place = {w: k for k, w in enumerate(words)}
    label = list(range(len(words)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for r in edges:
        a, b = sorted((root(place[r["a"] & (1 << 64) - 1]), root(place[r["b"] & (1 << 64) - 1])))
        label[b] = a
    assert [root(k) for k in range(len(words))] == plain_components(words)


def plain_removal(texts: list[bytes], size: int) -> list[tuple[bytes, int]]:
    met = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, dtype=int)
        for k in range(len(t) - size + 1):
            if met[t[k : k + size]] > 1:
                covered[k] += 1
                covered[k + size] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        out.append((bytes(b for b, g in zip(t, gone) if not g), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())))
    return out


@pytest.mark.parametrize("bucket_kinds", [1, 100_000])
def test_repeated_strings_agree_with_brute_force(spark, monkeypatch, bucket_kinds):
    random = np.random.default_rng(10)
    text = lambda letters, n: "".join(random.choice(list(letters), n))
    passages = [text("abcdefghij ", 70) for _ in range(4)]
    texts = [text("abcdefghijkl ", int(random.integers(0, 150))) + passages[int(random.integers(0, 4))][int(random.integers(0, 20)) : int(random.integers(45, 70))] + text("xyzé", int(random.integers(0, 60))) for _ in range(120)]
    texts += ["ab" * 60, "ab" * 45 + "c", "a" * 33, "a" * 31, "", passages[0] * 2, texts[0], texts[0]] + [text("ab", 90) for _ in range(15)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    whole = substrings.repeats
    monkeypatch.setattr(substrings, "repeats", lambda docs, size: whole(docs, size, bucket_kinds))
    rows = {r["doc_id"]: (bytes(r["kept_text"]), len(r["spans"])) for r in substrings.remove_repeats(frame, size=32).collect()}
    assert [rows[k] for k in range(len(texts))] == plain_removal([t.encode() for t in texts], 32)


def test_repeated_strings_of_odd_documents(odd_docs, empty_docs):
    docs = odd_docs.collect()
    rows = substrings.remove_repeats(odd_docs, keep=["doc_id", "text"]).collect()
    want = Counter((d["doc_id"], d["text"], *w) for d, w in zip(docs, plain_removal([(d["text"] or "").encode() for d in docs], 400)))
    assert Counter((r["doc_id"], r["text"], bytes(r["kept_text"]), len(r["spans"])) for r in rows) == want
    assert substrings.remove_repeats(empty_docs).count() == 0


def test_multikey_order():
    random = np.random.default_rng(11)
    strings = [bytes(random.integers(0, 3, int(random.integers(0, 40)), dtype=np.uint8)) for _ in range(300)]
    order, common = substrings.ordered(strings, 32)
    padded = [s[:32].ljust(32, b"\0") for s in strings]
    assert [padded[k] for k in order] == sorted(padded)
    for a, b, n in zip(order, order[1:], common[1:]):
        x, y = strings[a][:32], strings[b][:32]
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_digests_of_the_suffix_query(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    want = {d: (len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for (d, t), (k, n) in zip(docs, plain_removal([t for _, t in docs], 400))}
    found = QUERIES["op10_suffix_dedup"](spark, ROOT).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == want
