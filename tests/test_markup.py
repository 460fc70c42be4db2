"""Pages as they are saved: comments, scripts, signs in attributes, tables in cells, end tags left out, entities."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalog_engine.operators import extract
from catalog_engine.operators.markup import canonical
from catalog_engine.sources import catalog


def page(spark, html):
    return spark.createDataFrame([(1, html)], "k int, html string")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


CASES = [
    ("<p>a</p>", "<p>a</p>"),
    ("<!-- <a href='x'>c</a> --><a class='x>y' href='/a?b=1'>t</a><script>if(a<b){'<a>'}</script>z", "<a class='x&gt;y' href='/a?b=1'>t</a>z"),
    ("a<!-- never closed <td>", "a"), ("<STYLE>p > a {}</STYLE>b<script src=x>", "b"), ("1 < 2 > 0", "1 < 2 > 0"), ("", ""), (None, None),
    ("<table><tr><th>A<td>1<tr><th>B<td>2</table>x", "<table><tr><th>A</th><td>1</td></tr><tr><th>B</th><td>2</td></tr></table>x"),
    ("<table><thead><tr><th>A<tbody><tr><td>1", "<table><thead><tr><th>A</th></tr><tbody><tr><td>1</td></tr>"),
    (
        "<table><tr><td><table><tr><td>a</td></tr></table> b</td></tr></table><table><tr><td>c</td></tr></table>",
        "<table><tr><td><x-table><x-tr><x-td>a</x-td></x-tr></x-table> b</td></tr></table><table><tr><td>c</td></tr></table>",
    ),
    (
        "<TABLE><TR><TD><table><tr><td><table><tr><td>a</table></table>b</TABLE></table>c<table><tr><td>d</table>",
        "<TABLE><TR><TD><x-table><x-tr><x-td><x-table><x-tr><x-td>a</x-table></x-table>b</TD></TR></TABLE></table>c<table><tr><td>d</td></tr></table>",
    ),
]


def test_canonical_form(spark):
    frame = spark.createDataFrame([(k, html) for k, (html, _) in enumerate(CASES)], "k int, html string")
    shown = {r["k"]: r["c"] for r in frame.select("k", canonical("html").alias("c")).collect()}
    for k, (html, want) in enumerate(CASES):
        assert shown[k] == want or (shown[k] or "").lower() == (want or "").lower(), html
    # a canonical page stays as it is
    again = frame.select("k", canonical("html").alias("c")).select("k", canonical("c").alias("c")).collect()
    assert {r["k"]: r["c"] for r in again} == shown


def test_many_tables_and_long_pages(spark):
    html = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2_000)), lambda i: F.concat(F.lit("<table><tr><th>k"), i.cast("string"), F.lit("<td>"), i.cast("string"), F.lit("<table><tr><td>in</table></table>"))), ""), F.repeat(F.lit("<p>x > y</p>"), 20_000))
    found = extract.extract_fields(spark.range(1).select(html.alias("html")), "html", ["k1999"])
    assert rows_of(found) == [("k1999", "1999\nin")]


def test_features(spark):
    html = """<section id="fiche_caracteristiques"><table><!-- <tr><th>Old<td>gone</tr> --><tr><th>Edge<td><table><tr><td>Reeded</td></tr></table> fine
      <tr><th title="a>b">Mass (g):</th><td>5 &eacute; <div class="tooltip">hint</div></td></tr></table></section>"""
    assert rows_of(extract.extract_feature_rows(page(spark, html), "html")) == [(1, "edge", "Reeded fine"), (1, "mass_g", "5 é")]


def test_titles_links_and_people(spark):
    html = """<!-- <h1>No</h1> --><script>x = "<h1>no</h1>"</script><h1 data-x="a>b">1 Cent &amp; x<span>Sub</span></h1>
      <!-- <a href="/hidden">h</a> --><a class='x>y' href='/a?b=1&amp;c=2'>t</a><script>"<a href='/s'>s</a>"</script><a href=/bare>u</a>
      <p><strong>Engravers:</strong> <em>A</em>, <a href="/artist.php?id=7&amp;l=1"><b>B</b> b</a> <br/>, C</p>"""
    assert rows_of(extract.extract_title(page(spark, html), "html")) == [(1, "1 Cent & x", "Sub")]
    links = extract.extract_links(page(spark, html), "html").collect()
    assert [(r["href"], r["text"]) for r in links] == [("/a?b=1&c=2", "t"), ("/bare", "u"), ("/artist.php?id=7&l=1", "B b")]
    people = extract.extract_people(page(spark, html), "html").collect()
    assert [(r["name"], r["href"], r["artist_id"]) for r in people] == [("A", None, None), ("B b", "/artist.php?id=7&l=1", 7), ("C", None, None)]


def test_mintage_with_a_table_in_a_cell(spark):
    html = """<h3>Mintage</h3><table><thead><tr><th>Year<th>Mark<th>Unc</thead><tbody><tr><td>1900<td><table><tr><td>D</td></tr></table><td>5
      <!-- <tr><td>1899</td></tr> --><tr><td>1901</td><td>P</td><td>7</td></tr></tbody></table>"""
    found = extract.extract_mintage(page(spark, html), "html").orderBy("year").collect()
    assert [(r["year"], r["mark"], r["unc"]) for r in found] == [(1900, "D", 5), (1901, "P", 7)]


def test_addresses_are_resolved(spark):
    face = """<h3>Obverse</h3><table class="coin-desc"><tr><th><img alt='x>y' src="a&amp;b.jpg"></th></tr></table>"""
    assert extract.extract_face(page(spark, face), "html", "Obverse").first()["reference_image"] == "a&b.jpg"
    listing = """<header><h2>P</h2></header><div class="description_piece"><strong><a href="/a&amp;b">n</a></strong></div>"""
    assert extract.extract_period_sections(page(spark, listing), "html").first()["href"] == "/a&b"
    media = """<a class="coin_pic" href='/p/x.php?a=1&amp;f=/q/a&amp;b.jpg'><img alt="Obverse" src=s.jpg></a>"""
    assert extract.extract_media(page(spark, media), "html").first()["face_a"] is not None


@pytest.mark.parametrize("value, want", [('"a&amp;b"', "a&b"), ("'a\"b'", 'a"b'), ("bare", "bare"), ('""', None)])
def test_attribute_forms(spark, value, want):
    tag = f"<a data-href='no' title=\"x href='y'\" href={value} id=z>"
    assert spark.range(1).select(extract.attribute(F.lit(tag), "href")).first()[0] == want


def test_rows_in_sql(spark):
    catalog.register_html_rows(spark)
    html = "<table><tr><th>A &amp; B<td><table><tr><td>in<td>side</table> &eacute;<td>3<tr><td>4</table>"
    page(spark, html).createOrReplaceTempView("one_page")
    found = spark.sql("SELECT row_no, cell_no, is_header, text FROM one_page, LATERAL html_rows(html)")
    assert rows_of(found) == [(1, 1, True, "A & B"), (1, 2, False, "in side é"), (1, 3, False, "3"), (2, 1, False, "4")]


def test_a_heading_cut_off_in_an_entity(spark):
    pages = page(spark, "<h1>a &amp;&amp</h1>")
    assert rows_of(extract.extract_title(pages, "html", closed=True)) == [(1, "a &&amp", None)]
    assert rows_of(extract.extract_title(pages, "html")) == [(1, "a &&", None)]


def test_pages_made_of_short_rows_are_many_tasks(spark):
    from catalog_engine.plans.bind_extract import media_pages, part_pages
    from catalog_engine.plans.binding import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert all(pages(t).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for pages in (part_pages, media_pages))


@pytest.mark.parametrize(
    ("html", "inner"),
    [("<div>a</div>b</div>", "a"), ("<div>a<div>b</div>c</div>d", "a<div>b</div>c"), ("<div>a<p>b", "a<p>b"), ("<div>a<div>b</div>c", "a<div>b</div>c"), ("<div><div></div></div>", "<div></div>"), ("x", None)],
)
def test_content_of_an_element(spark, html, inner):
    assert page(spark, html).select(extract.region("html", "div")).first()[0] == inner


@pytest.mark.parametrize("text, want", [
    ('<A x="a > b">t</a>', '<A x="a &gt; b">t</a>'), ("<a x='<'>t</a>", "<a x='&lt;'>t</a>"), ('a = "b > c" <i>', 'a = "b > c" <i>'),
    ("a<SCRIPT>x</Script>b<!-- c", "ab"), ("<TABLE><TR><TD>1</TABLE>", "<TABLE><TR><TD>1</td></tr></TABLE>"),
])
def test_markup_is_found_in_capitals_and_behind_equals_signs(spark, text, want):
    assert page(spark, text).select(canonical("html")).first()[0] == want
