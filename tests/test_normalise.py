"""Worked examples and odd rules of the text normalisers and field parsers."""

from __future__ import annotations

import html.entities

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog_engine.functions import normalise as n
from catalog_engine.operators import fields


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r["v"] for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def test_clean_text(spark):
    texts = ["a&nbsp;&amp; b", " 1⁄480 x y ", "caf&#233; &#x41; &unknown; &", "plain", ""]
    assert values(spark, texts, n.clean_text("s")) == ["a & b", "1/480 x y", "café A &unknown; &", "plain", ""]


def test_clean_text_with_closed_entities_only(spark):
    texts = ["a&amp;&amp</h1>", "&lt &lt; &eacute", "&#233 &#233;"]
    assert values(spark, texts, n.clean_text("s", closed=True)) == ["a&&amp</h1>", "&lt < &eacute", "&#233 é"]


def test_small_coordinates_have_an_exponent(spark):
    texts = ["map.flyTo([5.0E-4, -1e+1], 9)", "map.flyTo( [-12.5 , 3], 9)", "map.flyTo([., 1], 2)", "map.flyTo([1E, 1], 2)"]
    found = values(spark, texts, n.extract_lat_lon("s"))
    assert [tuple(r) for r in found] == [(0.0005, -10.0), (-12.5, 3.0), (None, None), (None, None)]


def test_slugify(spark):
    texts = ["½ é", "Grand Duchy-of Łódź", "ﬁne Ⅻ ²", "__x__", "Ünïcödé 12½"]
    assert values(spark, texts, n.slugify("s")) == ["1_2_e", "grand_duchy_of_odz", "fine_xii_2", "x", "unicode_121_2"]


def test_fold_text(spark):
    texts = ["Élan-vital (São)", "École", "Ångström  Đ", "ABC"]
    assert values(spark, texts, n.fold_text("s")) == ["elan vital sao", "ecole", "angstrom", "abc"]


@pytest.mark.parametrize("name", ["fold_text", "slugify"])
def test_folding_agrees_with_python_on_all_latin_letters(spark, name):
    import re
    import unicodedata

    texts = ["".join(chr(c) for c in range(start, start + 16)) for start in range(0xA0, 0x2200, 16)] + ["ﬀﬁﬂﬃﬄ"]

    def fold(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s).lower() if not "̀" <= c <= "ͯ")
        return " ".join(re.sub("[^a-z0-9]", " ", s).split())

    def slug(s):
        s = unicodedata.normalize("NFKD", s).replace("⁄", "_").encode("ascii", "ignore").decode()
        return re.sub("[^a-z0-9]+", "_", s.lower()).strip("_")

    expected = [fold(t) if name == "fold_text" else slug(t) for t in texts]
    assert values(spark, texts, getattr(n, name)("s")) == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("aÉß½ -_09ﬁ⁄\n€"), max_size=12), min_size=1, max_size=20))
def test_slugs_are_stable(spark, texts):
    once = values(spark, texts, n.slugify("s"))
    assert values(spark, once, n.slugify("s")) == once


def test_numbers_and_ids(spark):
    assert values(spark, ["1,234", "-", "–", "", None, "abc"], n.digits_int("s")) == [1234, None, None, None, None, None]
    assert values(spark, ["/x?id=45&a=1", "/x?a=1", "/x?k%5B%5D=34"], n.url_param_id("s", "id")) == [45, None, None]
    assert values(spark, ["/x?k%5B%5D=34#t"], n.url_param_id("s", "k[]")) == [34]
    assert values(spark, ["http://h/a/2345?x=1", "/path/77", "/none"], n.url_path_id("s")) == [2345, 77, None]
    assert values(spark, ["/coin/albania-1-lek/?tid=3", "/other/x"], n.url_slug_part("s")) == ["albania", None]
    assert values(spark, ["slug_12", "slug", "a_b_3"], n.folder_id("s")) == [12, None, 3]
    assert values(spark, ["slug_12", "slug", "a_b_3"], n.folder_slug("s")) == ["slug", "slug", "a_b"]
    assert values(spark, ["https://x/abc-original.jpg?v=1", "https://x/", "abc-original.jpg"], n.file_name("s", strip_original=True)) == ["abc.jpg", None, "abc.jpg"]
    assert values(spark, ["http://x/a.JPEG?z", "http://x/a.gif"], n.image_extension("s")) == [".jpg", ".jpg"]


def test_years(spark):
    ranges = values(spark, ["1228-1277 (1813-1860)", "1926", "1928 – 1925", "none", "12"], n.parse_year_range("s"))
    assert [tuple(r) for r in ranges] == [(1813, 1860, 1228, 1277), (1926, 1926, None, None), (1925, 1928, None, None), (None,) * 4, (None,) * 4]
    assert values(spark, ["3rd century BC", "", "c. 1900-1910"], n.start_year("s")) == [-3, 2147483647, 1900]


def test_names(spark):
    split = values(spark, ["Name (Alt)", "Name", "(x)"], n.split_parenthetical("s"))
    assert [tuple(r) for r in split] == [("Name", "Alt"), ("Name", None), ("", "x")]
    context = values(spark, ["Principality › Rudolph", "a › b » c", "plain"], n.split_context("s"))
    assert [tuple(r) for r in context] == [("Rudolph", "Principality"), ("c", "a › b"), ("plain", None)]
    assert values(spark, ["(1900)", "x (1)", "(a) b"], n.strip_wrapping("s")) == ["1900", "x (1)", "(a) b"]
    assert values(spark, ["25 x 30 MM", "mm", "12 cm"], n.parse_size("s")) == ["25 x 30", None, "12 cm"]


def test_titles(spark):
    rows = spark.createDataFrame(
        [("Elizabeth II", "Niue: Queen Elizabeth II (1952)", None), ("Duke of X", None, None), ("Y", None, "Grand Duke of Z."), ("Q", "none", "x")],
        "name string, heading string, intro string",
    )
    assert [r[0] for r in rows.select(n.rulers_title("name", "heading", "intro")).collect()] == ["Queen", "Duke", "Grand Duke", None]


def test_denominations(spark):
    texts = ["½ Dollar", "12½ Cents", "3 Marks", "Daler", "12/5 x", "1/0 x", "5 Francs = 1 Ecu", "1,000 Reis", "12 1/2", " 2 Pence ", "", "5 (a) (a) b", "Ⅻ x"]
    rows = fields.parse_denomination(spark.createDataFrame(list(enumerate(texts)), "i int, s string"), "s").orderBy("i").collect()
    assert [r["denomination_value"] for r in rows] == [0.5, 12.5, 3.0, 1.0, 1.4, None, 5.0, 1.0, 12.5, 2.0, None, 5.0, None]
    assert [r["denomination_text"] for r in rows[:4]] == ["1/2 Dollar", "12 1/2 Cents", "3 Marks", "1 Daler"]
    assert rows[6]["denomination_text"] == "5 Francs" and rows[6]["denomination_alt"] == "1 Ecu"
    assert rows[11]["info_1"] == "a" and rows[12]["non_digit_start"]
    strict = fields.parse_denomination(spark.createDataFrame([("12/5 x",), ("1 2/4",)], "s string"), "s", strict=True)
    assert [r["denomination_value"] for r in strict.collect()] == [2.4, 1.5]


def test_measures(spark):
    texts = ["1.3 g (with ring)", "1,3 g", "about 2 g", "1.5d", "", " 7 g"]
    rows = fields.parse_measure(spark.createDataFrame(list(enumerate(texts)), "i int, s string"), "s", "g", "w").orderBy("i").collect()
    assert [(r["w"], r["w_info"], r["w_exception"]) for r in rows] == [
        (1.3, "with ring", None), (1.3, None, None), (None, None, "about 2 g"), (None, None, "1.5d"), (None, None, None), (7.0, None, None)
    ]


def test_placeholders(spark):
    texts = ["Unknown", "unknown - help us to know", "12"]
    assert values(spark, texts, n.null_if_unknown("s")) == [None, None, "12"]
    assert values(spark, texts, n.null_if_unknown("s", "invite")) == ["Unknown", None, "12"]


def test_ordered_ids_sort_by_time(spark):
    rows = spark.range(50).select(F.timestamp_micros(F.col("id") * 777_777_777).alias("ts")).select("ts", n.ordered_hex_id("ts").alias("h"))
    assert [r["h"] for r in rows.orderBy("ts").collect()] == [r["h"] for r in rows.orderBy("h").collect()]


def test_every_name_of_an_entity_is_found_in_a_short_list(spark):
    names = dict(html.entities.html5) | {"nosuch;": "&nosuch;", "am": "&am"}
    frame = spark.createDataFrame([(f"x&{name}" if name.endswith(";") else f"x&{name} y", f"x{text}" + ("" if name.endswith(";") else " y")) for name, text in names.items()], "s string, want string")
    found = frame.select("want", n.resolved(F.col("s"), False).alias("resolved"), F.expr(n.unescape_sql("s")).alias("unescaped"))
    assert found.filter("resolved <> want OR unescaped <> want").count() == 0
    lists = spark.range(1).select(F.expr(n._dealt_names())).first()[0]
    assert max(x.count("\u0001") for x in lists) < 20 and sum(x.count("\u0001") for x in lists) == len(html.entities.html5)


@pytest.mark.parametrize("text, want", [("/a&amp;b&amp;amp;c", "/a&b&amp;c"), ("&amp;lt;&lt;", "&lt;<"), ("&amp &", "& &"), ("&amp;", "&"), ("plain", "plain")])
def test_escaped_signs_are_resolved_once(spark, text, want):
    assert spark.range(1).select(n.unescaped(F.lit(text))).first()[0] == want
