"""Shape of the physical plans."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from __spark_entry__ import entry, queries
from catalog_engine.operators import tables
from catalog_engine.plans import bind_aggregates

ROOT = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"flatten_nested_list", "dhash64_image", "corner_stats", "score_batches", "html_rows"}

def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["lookup_entity"](spark, ROOT)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,42)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_listing_reads_only_what_it_shows(spark):
    plan = entry(spark)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan
    assert "l_extendedprice" not in plan.split("== Physical Plan ==")[-1]


def test_dominance_takes_more_tasks_for_more_lines(spark, monkeypatch):
    """One shuffle of the lines, whose tasks hold so many lines at any size, and no join of the contests with themselves."""
    monkeypatch.setattr(bind_aggregates, "LINES_A_TASK", 100)
    lines = spark.read.parquet(f"{ROOT}/lineitem.parquet").count()
    for name, joins in (("dominance", 2), ("mark_dominance", 3)):
        plan = queries()[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in x]
        assert len(dealt) == 2 and all(f", {-(-lines // 100)})" in x for x in dealt)
        # with the parts, once for each branch, and of the members with their verdicts
        assert plan.count("Join") == joins


def test_entry_returns_rows(spark):
    listing = entry(spark)
    assert listing.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "face_a", "face_b"]
    assert listing.count() == 1500


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Python code runs in workers that cannot import the package, as on a cluster."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from __spark_entry__ import queries\n"
        f"for name in {sorted(PYTHON_QUERIES)!r}:\n"
        f"    queries()[name](spark, {ROOT!r}).write.format('noop').mode('overwrite').save()\n"
    )
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_only_changes_of_a_type_tell_who_is_promoted(spark):
    samples = spark.range(9).selectExpr("id", "id % 3 AS entity", "1 AS sample_type", "0 AS removed", "'a' AS face_a", "'b' AS face_b")
    changes = spark.range(9).selectExpr("id", "1 AS seq", "if(id = 4, 'promote', 'swap') AS kind", "id AS number", "'x' AS text_a", "'y' AS text_b")
    changed = tables.apply_changes(samples, changes, "id", "entity", [])
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in x and "IN (set_type,promote,transfer)" in x for x in plan.splitlines())
    assert {r["id"]: r["sample_type"] for r in changed.collect()} == {0: 1, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 8: 1}
