"""Near copies of the pipeline against brute-force Jaccard: nothing else goes, and at least nine in ten go that should."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from catalog_engine.llm import nearcopies


def plain_classes(texts: list[str | None]) -> list[int]:
    """For each text the first of its class: connected by pairs with a Jaccard similarity of 0.8 of 5-word shingles."""
    sets = []
    for text in texts:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(texts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                one, two = sorted((root(k), root(j)))
                label[two] = one
    return [root(k) for k in range(len(texts))]


def assert_recall(kept: set, wanted: set, rows: int) -> None:
    """The first of every class stays; of the others at most one in ten."""
    assert wanted <= kept and len(kept - wanted) <= 0.1 * (rows - len(wanted))


def near_texts() -> list[str]:
    random = np.random.default_rng(12)
    vocabulary = ["".join(random.choice(list("abcdefghij"), 5)) for _ in range(4000)]
    write = lambda n: [str(w) for w in random.choice(vocabulary, n)]
    passage, stories = write(60), [write(int(n)) for n in random.integers(40, 200, 25)]
    texts = [stories[0]]
    for k in range(260):
        copy = list(stories[0] if k < 120 else stories[int(random.integers(0, 25))])
        for at in random.integers(0, len(copy), int(random.integers(0, 1 + len(copy) // 25))):
            copy[at] = write(1)[0]
        texts.append(copy + (write(int(random.integers(0, 30))) if k % 3 else []))
    texts += [write(int(n)) + passage for n in random.integers(0, 40, 60)]
    return [" ".join(t) for t in texts] + ["", "one", "One two", "one two"]


def test_classes_agree_with_brute_force(spark):
    texts = near_texts()
    want = plain_classes(texts)
    assert len(set(want)) < len(texts) - 60 and len(set(want)) > 60
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    assert_recall({r["doc_id"] for r in kept.collect()}, set(want), len(texts))


def test_near_copies_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    wanted = {rows[k][0] for k in set(plain_classes([t for _, t in rows]))}
    assert len(wanted) < len(rows) - 50
    assert_recall({r["doc_id"] for r in kept.collect()}, wanted, len(rows))


def test_near_copies_of_odd_documents(odd_docs, empty_docs):
    docs = odd_docs.collect()
    least = {}
    for d, c in zip(docs, plain_classes([d["text"] for d in docs])):
        if d["doc_id"] is not None:
            least[c] = min(d["doc_id"], least.get(c, d["doc_id"]))
    kept = nearcopies.keep_first_near(odd_docs)
    assert kept.columns == odd_docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())
    assert nearcopies.keep_first_near(empty_docs).count() == 0


def test_links_at_the_least_similarity(spark):
    """Pairs just over and just under 0.8, each with words of its own."""
    random = np.random.default_rng(14)
    over, under, rows = [], [], []
    for k in range(400):
        words = [f"w{random.integers(0, 10**9)}" for _ in range(300)]
        share = 0.8 + (0.02 if k % 2 else -0.02)
        cut = int(300 * share)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:cut]))]
        (over if k % 2 else under).append(2 * k + 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in nearcopies.keep_first_near(frame).select("doc_id").collect()}
    assert set(under) <= kept and len(kept & set(over)) <= 0.1 * len(over)


def test_a_group_costs_its_size(spark):
    random = np.random.default_rng(15)
    story = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(3_000):
        copy = list(story)
        copy[int(random.integers(0, 150))] = f"x{k}"
        texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = nearcopies.signatures(frame, ["doc_id"])
    shards, width = nearcopies.dealt(sets)
    assert nearcopies.tried(shards, None, width).count() < 10 * len(texts)
    assert [r["doc_id"] for r in nearcopies.keep_first_near(frame).collect()] == [0]
    # one class holds nearly all: only the others ask again
    marks = sets.select("fp", nearcopies.F.lit(1).cast("long").alias("label"))
    assert nearcopies.tried(shards, marks, width).count() == 0


def test_blocks_of_a_large_shard_meet(spark):
    texts = near_texts()
    sets = nearcopies.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"])
    whole, width = nearcopies.dealt(sets)
    parts, same = nearcopies.dealt(sets, shard_rows=40)
    ends = lambda pairs: {x for r in pairs.collect() for x in r}
    assert same == width and parts.filter("low < high").count() > 0
    one, two = ends(nearcopies.tried(whole, None, width)), ends(nearcopies.tried(parts, None, width))
    # a word is led by another in another block
    assert len(one & two) >= 0.85 * len(one | two)


def test_every_near_pair_of_two_classes_is_tried_in_slices():
    """A word whose one true partner is the farthest of 600 near words, all of one other class."""
    random = np.random.default_rng(16)
    words = np.zeros((700, 2), dtype=np.uint64)
    for k in range(700):
        for b in random.choice(np.arange(16, 128), 8, replace=False):
            words[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    labels = np.array([0] * 600 + list(range(1, 101)))
    away = nearcopies.distances(words, words)
    near = (away <= 30) & (labels[:, None] != labels[None, :]) & (labels[:, None] > 0)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if nearcopies.met_here(words[[a]], words[[b]], 0)[0]}
    found, start = set(), 0
    while True:
        one, two = nearcopies.rest_of_others(words, labels, 0, 30, start)
        if not len(one):
            break
        part = set(zip(one.tolist(), two.tolist()))
        assert not part & found and max(np.unique(one, return_counts=True)[1]) <= nearcopies.SLICE
        found, start = found | part, start + nearcopies.SLICE
    assert found == want and start > nearcopies.SLICE
    tried = nearcopies.nearest_of_others(words, labels, 0, 30)
    assert len(set(zip(*(x.tolist() for x in tried)))) < len(want)


def test_every_fingerprint_goes_to_as_many_shards(spark):
    """However many there are, so what is shuffled grows with the table; both ends of a pair within one bit meet."""
    for count in (50, 5_000):
        sets = spark.range(count).select(nearcopies.F.col("id").alias("fp"), nearcopies.F.xxhash64("id").alias("one"), nearcopies.F.xxhash64("id", "id").alias("two"))
        shards, width = nearcopies.dealt(sets)
        assert shards.count() == 2 * nearcopies.PIECES * count and shards.filter(f"cell >= {width * nearcopies.PIECES}").isEmpty()


def family(random, size: int = 500) -> list[list[str]]:
    """Texts that are near by their fingerprints, of which few are near copies of each other."""
    story = [f"w{k}" for k in range(200)]
    out = []
    for k in range(size):
        copy = list(out[k // 2]) if k % 5 == 4 else list(story)
        for at in random.choice(200, 1 if k % 5 == 4 else 7, replace=False):
            copy[at] = f"x{k}-{at}"
        out.append(copy)
    return out


def test_a_family_gives_links_not_pairs(spark):
    texts = [" ".join(t) for t in family(np.random.default_rng(18))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    marked = nearcopies.signatures(frame, ["doc_id", "text"])
    seen = []
    real = nearcopies.near_links
    for block_bytes in (nearcopies.BLOCK_BYTES, 40_000):
        links = real(marked.select("fp", "one", "two"), marked.select("fp", "text"), block_bytes).collect()
        root = {}

        def top(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(top(a), top(b))] = min(top(a), top(b))
        seen.append({r["doc_id"]: top(r["fp"]) for r in marked.select("doc_id", "fp").collect()})
        assert len(links) < 24 * len(texts)
    assert seen[0] == seen[1]
    want = plain_classes(texts)
    assert 100 < len(set(want)) < len(texts)
    together = {(a, b) for a in range(len(texts)) for b in range(a) if want[a] == want[b]}
    found = {(a, b) for a in range(len(texts)) for b in range(a) if seen[0][a] == seen[0][b]}
    assert found <= together and len(found) >= 0.95 * len(together)


def test_what_is_staged_leaves_no_shuffle_files(spark):
    import time

    from catalog_engine.workspace import staged

    files = lambda: sum("shuffle_" in str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = files(), spark.conf.get(key)
    frame = spark.range(1000).groupBy((nearcopies.F.col("id") % 7).alias("k")).count()
    assert len(staged(frame, "few").collect()) == 7 and spark.conf.get(key) == conf
    for _ in range(50):
        own = files() - before
        if own <= 1:
            break
        time.sleep(0.2)
    assert own <= 1 and frame.count() == 7
