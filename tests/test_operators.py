"""Properties, brute-force comparisons and behaviour on hot groups."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog_engine.functions.normalise import clean_text
from catalog_engine.operators import aggregates, dataset, extract, filters, joins, numbering, similar, tables, tree
from catalog_engine.operators.quality import parse_exceptions


def skewed(spark, rows=4000):
    """A third of all rows under one key."""
    return spark.range(rows).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), F.hash("id").alias("v"), "id")


@pytest.mark.parametrize(("keys", "hot_rows"), [(["k"], 10**9), (["k"], 100), (["k"], 1000), ([], 1)])
def test_row_numbers_of_hot_groups(spark, keys, hot_rows):
    rows = skewed(spark)
    order = [F.col("v"), F.col("id")]
    window = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    plain = rows.withColumn("n", F.row_number().over(window).cast("bigint"))
    spread = numbering.spread_row_number(rows, keys, order, "n", hot_rows)
    assert spread.count() == rows.count()
    assert spread.exceptAll(plain).isEmpty()


def test_running_minimum_of_a_long_run(spark):
    rows = skewed(spark).withColumn("v", F.col("v") % 1000 - F.col("id"))
    plain = dataset.improvements(rows, "k", "id", "v")
    assert dataset.improvements(rows, "k", "id", "v", hot_rows=100).exceptAll(plain).isEmpty()


def test_null_keys_stay_in_one_group(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 2 == 0, 1).alias("k"), "id")
    spread = numbering.spread_row_number(rows, ["k"], [F.col("id")], "n", 100)
    assert spread.agg(F.max("n")).first()[0] == 150


def test_chunked_children_lose_nothing(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    children = spark.range(2500).select(F.lit(1).cast("long").alias("p"), "id").union(spark.range(3).select(F.lit(2).cast("long"), "id"))
    detail = filters.project_detail(parents, children, "k", "p", [F.col("id")], ["id"], chunk=1000).orderBy("k", "chunk_no").collect()
    assert [(r["k"], r["chunk_no"], len(r["children"] or [])) for r in detail] == [(1, 0, 1000), (1, 1, 1000), (1, 2, 500), (2, 0, 3), (3, 0, 0)]
    assert [c["id"] for r in detail if r["k"] == 1 for c in r["children"]] == list(range(2500))


def brute_dominance(rows):
    met, lost = set(), set()
    for c, o, m, f in rows:
        for c2, o2, m2, f2 in rows:
            if c == c2 and o == o2 and m != m2:
                met.add(m)
                if not (f == 1 and f2 == 0):
                    lost.add(m)
    return {m: int(m not in lost) for m in met}


def test_dominance_agrees_with_all_pairs(spark):
    rnd = random.Random(7)
    rows = {(rnd.randrange(40), rnd.randrange(3), rnd.randrange(25)): rnd.choice([0, 1, 1, None]) for _ in range(160)}
    rows = [(*k, v) for k, v in rows.items()] + [(99, 9, 900, 1), (99, 9, 901, 0), (98, 9, 900, 1), (98, 9, 902, 0)]
    verdicts = aggregates.dominance(spark.createDataFrame(rows, "c int, o int, m int, f int"), "c", "o", "m", "f").collect()
    found = {r["m"]: r["is_primary"] for r in verdicts}
    assert found == brute_dominance(rows) and found[900] == 1


def test_dominance_of_rows_without_contest_owner_or_member(spark):
    rows = [(1, None, 1, 1), (1, None, 2, 0), (None, 1, 3, 1), (None, 1, 4, 0), (2, 1, None, 1), (2, 1, 5, 0), (3, 1, 6, 1), (4, 1, 7, 1), (4, 1, 8, None)]
    verdicts = aggregates.dominance(spark.createDataFrame(rows, "c int, o int, m int, f int"), "c", "o", "m", "f").collect()
    assert {r["m"]: r["is_primary"] for r in verdicts} == {1: 1, 2: 0, None: 1, 5: 0, 7: 0, 8: 0}


def brute_leaders(rows, limit):
    groups, numbers = {}, {}
    for scope in {r[0] for r in rows}:
        items = sorted((i, h) for s, i, h in rows if s == scope)
        taken, number = set(), 0
        for at, (i, h) in enumerate(items):
            if i in taken:
                continue
            near = [j for j, g in items[at:] if j not in taken and (h ^ g).bit_count() <= limit]
            taken.update(near)
            if len(near) > 1:
                number += 1
                groups.update({j: number for j in near})
    numbers.update(groups)
    return numbers


def hash_rows(seed=3):
    rnd = random.Random(seed)
    rows = []
    for scope in range(2):
        centres = [rnd.getrandbits(62) for _ in range(6)]
        for i in range(60):
            h = rnd.choice(centres)
            for _ in range(rnd.randrange(8)):
                h ^= 1 << rnd.randrange(62)
            rows.append((scope, scope * 1000 + i, h))
    return rows


@pytest.mark.parametrize("limit", [0, 9, 40, 47, 48, 63])
def test_leader_groups_agree_with_the_greedy_loop(spark, limit):
    rows = hash_rows() + [(None, 5_000 + i, h) for i, (_, _, h) in enumerate(hash_rows(7)[:40])] + [(7, 9_000, 0), (7, 9_001, -1), (7, 9_002, 1), (8, 9_100, 5)]
    grouped = similar.leader_groups(spark.createDataFrame(rows, "s int, i long, h long"), "s", "h", "i", limit).collect()
    expected = brute_leaders([(s, i, h % 2**64) for s, i, h in rows], limit)
    assert len(grouped) == len(rows)
    assert {r["i"]: r["group_id"] for r in grouped} == {i: expected.get(i) for _, i, _ in rows}


@pytest.mark.parametrize("limit", [3, 9, 15, 20])
def test_near_pairs_agree_with_all_pairs(spark, limit):
    rows = list({(s, h): (s, i, h) for s, i, h in hash_rows(5)}.values())
    found = similar.hamming_pairs(spark.createDataFrame(rows, "s int, i long, h long"), "s", "h", "i", limit).collect()
    expected = {(s, min(i, j), max(i, j), (g ^ h).bit_count()) for s, i, g in rows for z, j, h in rows if s == z and i != j and (g ^ h).bit_count() <= limit}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_copies_are_linked_not_paired(spark):
    rows = [(0, i, 5) for i in range(200)] + [(0, 500, -1)]
    pairs = similar.hamming_pairs(spark.createDataFrame(rows, "s int, i long, h long"), "s", "h", "i")
    assert pairs.count() == 199
    assert similar.similar_components(pairs).groupBy("component").count().collect()[0]["count"] == 200


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)]
    found = {r["id"]: r["component"] for r in similar.similar_components(spark.createDataFrame(chain + star, "id_a long, id_b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_swapping_faces_flips_the_verdict(spark):
    rnd = random.Random(1)
    vector = lambda: [rnd.uniform(-1, 1) for _ in range(16)]
    front, back = vector(), vector()
    noisy = lambda v: [x + rnd.uniform(-0.1, 0.1) for x in v]
    rows = [(0, 1, front, back), (1, 1, noisy(front), noisy(back)), (2, 1, noisy(back), noisy(front))]
    samples = spark.createDataFrame(rows, "i long, g int, a array<float>, b array<float>")
    verdict = {r["i"]: r["swapped"] for r in similar.detect_swaps(samples, "g", F.col("i") == 0, "i", "a", "b").collect()}
    assert verdict == {1: False, 2: True}


def test_duplicate_plan_leaves_one_row_per_content(spark):
    rows = skewed(spark, 900).select((F.col("k") % 3).alias("s"), (F.col("k") % 7).cast("string").alias("h"), (F.col("id") % 4).alias("t"), (F.col("v") % 5).alias("z"), "id")
    plan = similar.exact_duplicates(rows, "s", "h", "t", "z", "id")
    left = rows.join(plan, rows["id"] == plan["deleted"], "left_anti")
    assert left.count() == rows.select("s", "h").distinct().count()
    assert plan.join(left, plan["survivor"] == left["id"], "left_anti").isEmpty()


@pytest.mark.parametrize(("ratio", "expected"), [(0.49, 0), (0.5, 1), (0.84, 1), (0.85, 0), (1.0, 0)])
def test_holders(spark, ratio, expected):
    row = spark.createDataFrame([(ratio * 100, 100.0)], "w double, h double")
    assert row.select(similar.is_holder("w", "h")).first()[0] == expected


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, kept int")
    source = spark.createDataFrame([(2, "x", 99, 1), (2, "y", 98, 2), (3, "z", 30, 1)], "k int, name string, kept int, seq int")
    once = tables.upsert(target, source, ["k"], ["name"], "seq")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 10), (2, "y", 20), (3, "z", 30)]
    assert sorted(map(tuple, tables.upsert(once, source, ["k"], ["name"], "seq").collect())) == sorted(map(tuple, once.collect()))


def test_ids_for_new_values(spark):
    dim = spark.createDataFrame([(4, "a"), (9, "b")], "id long, v string")
    ids = tables.get_or_create_ids(dim, "id", ["v"], spark.createDataFrame([("c",), ("a",), ("c",), ("aa",), (None,)], "v string"))
    assert sorted(map(tuple, ids.collect())) == [(4, "a"), (10, "aa"), (11, "c")]


def test_exceptions_merge_with_earlier_ones(spark):
    parsed = spark.createDataFrame([(1, "bad", False), (2, None, True), (3, None, False)], "k int, w string, f boolean")
    earlier = spark.createDataFrame([(1, "old", 1), (9, "keep", 0)], "k int, weight string, slash int")
    merged = parse_exceptions(parsed, "k", {"weight": "w"}, {"slash": "f"}, earlier)
    assert sorted(map(tuple, merged.collect())) == [(1, "bad", 0), (2, None, 1), (9, "keep", 0)]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("r", None, "Root"), ("a", "r", "Ála"), ("b", "r", "Bob"), ("c", "a", "Cy"), ("d", "c", "Dee"), ("x", "nowhere", "Lost"), ("y", "z", "Loop"), ("z", "y", "Loop")]
    return spark.createDataFrame(rows, "id string, parent string, name string")


def test_tree_paths(nodes):
    closure = tree.tree_closure(nodes, "id", "parent", "name")
    assert closure.filter("descendant = 'd'").orderBy("distance").select("ancestor").rdd.map(lambda r: r[0]).collect() == ["d", "c", "a", "r"]
    roots = {r["root_id"] for r in closure.collect()}
    assert roots == {"r", "x"}  # an unknown parent makes a root, a loop hangs below none


def test_path_to_one_node(nodes):
    path = tree.owner_of_path(nodes, "id", "parent", "d").orderBy("step").collect()
    assert [r["id"] for r in path] == ["r", "a", "c", "d"]
    assert [r["id"] for r in tree.owner_of_path(nodes, "id", "parent", "x").collect()] == ["x"]
    assert tree.owner_of_path(nodes, "id", "parent", "none").isEmpty()
    assert tree.owner_of_path(nodes, "id", "parent", "y").count() == 2


def test_both_filters_keep_more_than_ancestors(nodes):
    match = F.col("name") == "Cy"
    up = {r["id"] for r in tree.tree_filter_ancestors(nodes, "id", "parent", match).collect()}
    both = {r["id"]: r["expand"] for r in tree.tree_filter_both(nodes, "id", "parent", match).collect()}
    assert up == {"r", "a", "c"} and set(both) == {"r", "a", "c", "d"} and not both["d"] and both["r"]


def test_slug_parents_take_the_lowest_id(spark):
    rows = spark.createDataFrame([(1, "s", None), (2, "s", None), (3, "t", "s"), (4, "u", "gone")], "id long, slug string, up string")
    resolved = {r["id"]: r["parent_id"] for r in tree.resolve_slug_parents(rows, "id", "slug", "up").collect()}
    assert resolved == {1: None, 2: None, 3: 1, 4: None}


def test_updates_never_multiply_rows(spark):
    target = spark.createDataFrame([(1, "a", None, 0), (2, "b", "x", 0), (3, "c", "y; z", 0)], "id long, name string, info string, is_manual int")
    source = spark.createDataFrame([(1, "", "n", 1), (1, "q", "m", 2), (3, "", "z", 1), (3, "r", "w", 2), (9, "s", "v", 1)], "id long, name string, info string, at int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.coalesce_update(target, source, "id", ["name"], order="at")) == [(1, "q", None, 0), (2, "b", "x", 0), (3, "r", "y; z", 0)]
    assert rows(tables.append_info(target, source, "id", "info")) == [(1, "a", "m; n", 0), (2, "b", "x", 0), (3, "c", "y; z; w", 0)]
    assert rows(tables.bulk_update(target, source, "id", ["name"], "is_manual", "at")) == [(1, "q", None, 1), (2, "b", "x", 0), (3, "r", "y; z", 1)]
    owners = spark.createDataFrame([(1, 7, 1), (1, 5, 2)], "id long, owner_id long, at int")
    assert rows(tables.assign_owner(target.withColumn("owner_id", F.lit(0).cast("long")), owners, ["id"], order="at").select("id", "owner_id", "is_manual")) == [(1, 5, 1), (2, 0, 0), (3, 0, 0)]


def test_deep_trees_keep_all_nodes_and_loops_end(spark):
    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(300)] + [(900, 901), (901, 900), (902, 901), (903, 903)], "id long, parent_id long")
    found = {r["id"]: r for r in tree.tree_paths(nodes, "id", "parent_id").collect()}
    assert len(found) == 300 and all(found[k]["depth"] == k and found[k]["ancestors"] == list(range(k + 1)) for k in range(300))
    assert tree.owner_of_path(nodes.filter("id < 250"), "id", "parent_id", 249).count() == 250


def test_entities_and_open_addresses(spark):
    page = spark.createDataFrame([(1, "<a href=/x?a=1&amp;b=2>Gro&szlig; &eacute; &apos;&#x1F600; &lt</a> <a href='/y'>&nosuch; &</a>")], "id long, html string")
    assert [(r["href"], r["text"]) for r in extract.extract_links(page, "html").orderBy("ordinal").collect()] == [("/x?a=1&b=2", "Groß é '😀 <"), ("/y", "&nosuch; &")]
    assert spark.createDataFrame([("&apos;a\u2003\u3000b &lt",)], "s string").select(clean_text("s")).first()[0] == "'a b <"


def test_search_text_may_hold_quotes(spark):
    df = spark.createDataFrame([("Louis d'or",), ("dorado",)], "name string")
    assert [r[0] for r in filters.search_word_prefix(df, "name", "d'or").collect()] == ["Louis d'or"]


def test_block_is_cut_where_lower_case_is_longer(spark):
    df = spark.createDataFrame([("İİİ<div>x NEEDLE y</DIV>rest",)], "html string")
    assert extract.remove_block(df, "html", "needle", "<div>", "</div>").first()[0] == "İİİrest"


def test_nested_markup(spark):
    page = (
        '<p>a</p><div id="sale_offers"><div>x<div>y</div></div>z</div>k<div id="middle_element"><p>q</p><div>w</div>'
        '<main id="main"><div>keep</div></main><div>r</div></div>end<div class=ad>v<div>u</div></div>!'
    )
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, 'x<div id="sale_offers">open'), (5, '<div id="sale_offers_2">k</div>')], "id int, html string")
    kept = [r["html"] for r in extract.strip_boilerplate(rows, "html").orderBy("id").collect()]
    assert kept == ['<p>a</p>k<div id="middle_element"><main id="main"><div>keep</div></main></div>end!', None, "", "x", '<div id="sale_offers_2">k</div>']
    nested = spark.createDataFrame([('a<div id="q" class="x">1<DIV>2</div >3</div>4',)], "html string")
    assert nested.select(extract.region("html", "div", "id", "q").alias("r")).first()["r"] == "1<DIV>2</div >3"


def test_a_region_of_many_tags(spark):
    body = "<div>é</div>" * 5_000
    rows = spark.createDataFrame([(f'<i>x</i><div id="q">{body}</div>tail',)], "html string")
    assert rows.select(extract.region("html", "div", "id", "q").alias("r")).first()["r"] == body


def test_owners_by_name_and_territory_agree_with_brute_force(spark):
    texts = [""] + ["".join(p) for n in range(1, 8) for p in itertools.product("aB", repeat=n)][::3] + ["a" * 10_000, "a" * 9_999 + "b"]
    items = [(k, t, None, False) for k, t in enumerate(texts)] + [(len(texts), None, None, False)]
    owners = [(k, name, territory, False) for k, (name, territory) in enumerate([("aa", "b"), ("A", "B"), ("abab", "a"), ("aBaBa", "ba"), ("a" * 5_000, "b"), ("", "a"), (None, "b"), ("bb", None), ("aaa", "aaaa")])]

    def lowest(name):
        leaves = [o[1] for o in owners]
        same = [k for k, n, t, _ in owners if n is not None and n == name and (not t or leaves.count(n) <= 1)]
        fits = lambda n, t: t and n is not None and (n or not name) and len(name) >= len(n) + len(t) and name.lower().startswith(n.lower()) and name.lower().endswith(t.lower())
        return min(same + [k for k, n, t, _ in owners if fits(n, t)], default=None)

    found = joins.auto_associate(
        spark.createDataFrame(items, "row_id long, owner_name string, owner_id long, is_manual boolean"), spark.createDataFrame(owners, "id long, name string, territory string, is_section boolean")
    )
    assert {r["row_id"]: r["new_owner_id"] for r in found.collect()} == {k: None if n is None else lowest(n) for k, n, _, _ in items}


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("limit", [3, 15])
def test_hashes_by_blocks_and_by_bands(spark, block, limit):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    words = {w ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for w in base for _ in range(4)}
    rows = [(rng.choice(["a", "b", None]), w - (1 << 63), i, 1) for i, w in enumerate(sorted(words))]
    hashes = spark.createDataFrame(rows, "s string, h long, first_id long, copies long")
    sizes = hashes.groupBy(F.col("s").alias("_sized")).agg(F.count("*").alias("_n"))
    pairs = lambda df: sorted(tuple(sorted((r["id_a"], r["id_b"]))) + (r["distance"],) for r in df.collect())
    brute = sorted((i, j, (a ^ b).bit_count()) for (s, a, i, _), (t, b, j, _) in itertools.combinations([(s, h + (1 << 63), i, n) for s, h, i, n in rows], 2) if s == t and (a ^ b).bit_count() <= limit)
    assert brute and pairs(similar._near_by_blocks(hashes, sizes, "s", "h", limit, block)) == brute
    assert pairs(similar._near_by_bands(hashes, "s", "h", limit)) == brute


def test_few_hashes_are_compared_without_look_ups(spark):
    hashes = spark.range(200).select(F.lit("a").alias("s"), F.xxhash64("id").alias("h"), F.col("id").alias("first_id"), F.lit(1).alias("copies"))
    assert "_avalue" not in similar._near_hashes(hashes, "s", "h", 15)._jdf.queryExecution().analyzed().toString()
