"""Distrust does not thin out with the number of hosts that link to a blocked one."""

from __future__ import annotations

import pytest

from catalog_engine.llm import hosts
from catalog_engine.llm.queries import URL_RULES


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_farms_are_blocked_whatever_their_size(spark, size):
    link = lambda *targets: " ".join(f"<a href='http://{t}/'>x</a>" for t in targets)
    rows = [("http://bad.net/", "")] + [(f"http://farm{k}.com/", link("bad.net")) for k in range(size)]
    rows += [("http://paper.com/", link("bad.net", *[f"site{k}.com" for k in range(30)])), ("http://good.org/fr/", link("paper.com"))]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    verdict = {r["host"]: r["verdict"] for r in hosts.filter_urls(pages, URL_RULES).collect()}
    assert all(verdict[f"farm{k}.com"] == "block" for k in range(size)) and verdict["paper.com"] == "allow" == verdict["good.org"]


def _verdicts(spark, rows):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r["verdict"] for r in hosts.filter_urls(pages, URL_RULES).collect()}


def _link(*targets):
    return " ".join(f"<a href='http://{t}/'>x</a>" for t in targets)


def test_an_unrelated_link_changes_nothing(spark):
    rows = [("http://shop.com/", "")] + [(f"http://example.com/de/{k}", "") for k in range(5)] + [("http://example.com", "")] * 4
    apart = [*rows, ("http://u.com/", _link("v.com"))]
    assert _verdicts(spark, rows) == {k: v for k, v in _verdicts(spark, apart).items() if k < len(rows)}


def test_ordinary_hosts_with_a_bad_link_stay(spark):
    others = [f"site{k}.com" for k in range(999)]
    rows = [
        ("http://bad.net/", _link(*others[:20])), ("http://six.com/", _link("bad.net", *others[:5])), ("http://directory.com/", _link("bad.net", *others)),
        ("http://near.com/", _link("six.com")), ("http://half.com/", _link("bad.net", "site1.com")), ("http://hub.com/", _link("half.com")),
    ]
    rows += [(f"http://fan{k}.com/", _link("hub.com", "bad.net")) for k in range(50)] + [("http://ring1.com/", _link("ring2.com")), ("http://ring2.com/", _link("ring1.com"))]
    verdict = _verdicts(spark, rows)
    assert [verdict[k] for k in range(6)] == ["block", "allow", "allow", "allow", "block", "block"]
    assert all(verdict[k] == "block" for k in range(6, 56)) and verdict[56] == verdict[57] == "allow"
