"""Extraction from tables of documents.

A document is one row, so its parts are handled as arrays inside the row: the markup is first brought into one form
(``markup.canonical``), regular expressions cut it, higher-order functions pick and clean the pieces, and rows appear only at
the end through ``explode``. Nothing is shuffled and no text
leaves the JVM, except for nested lists, which need a stack.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions import normalise as n
from catalog_engine.functions.arrays import let
from catalog_engine.operators.markup import canonical

# an address in quotes or without
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?((?<=["'])[^"']*|(?<!["'])[^\s>"']+)["']?[^>]*>(.*?)</a>"""


def pieces(text: Column | str, pattern: str, group: int = 1) -> Column:
    """All matches of a group, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), group)


def filled(text: Column) -> Column:
    """The text, NULL when it is empty; unlike ``nullif`` it is worked out once in a lambda or a branch too."""
    return let(text, lambda t: F.when(t != "", t))


def part(text: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL without one."""
    return filled(F.regexp_extract(text, pattern, group))


def element(tag: str, attribute: str = "", value: str = "") -> str:
    """Pattern of a flat element, optionally with an attribute holding a word; group 1 is its content."""
    mark = rf"""[^>]*\b{attribute}\s*=\s*["'](?:[^"']*\s)?{re.escape(value)}(?:\s[^"']*)?["']""" if attribute else ""
    return rf"(?is)<{tag}\b{mark}[^>]*>(.*?)</{tag}>"


def _start(tag: str, attribute: str, value: str) -> str:
    """Pattern of a start tag, optionally with an attribute that holds a word."""
    mark = rf"""[^>]*\b{attribute}\s*=\s*["']?(?<=["'\s=])(?:[^"'>]*\s)?{re.escape(value)}(?=["'\s>/])""" if attribute else r"(?=[\s>/])"
    return rf"<{tag}\b{mark}[^>]*>"


def _end_of(tail: Column, tag: str) -> Column:
    """Where the element that ``tail`` begins with ends: the characters before its closing tag, nested ones of its kind counted."""
    first = F.regexp_extract(tail, rf"(?is)^.*?(?=</{tag}\b|\z)", 0)
    return let(first, lambda f: F.when(f.rlike(rf"(?is).<{tag}\b"), _end_of_nested(tail, tag)).otherwise(F.length(f)))


def _end_of_nested(tail: Column, tag: str) -> Column:
    tags = F.split(tail, rf"(?i)(?=</?{tag}\b)")
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(-1).alias("end"))

    def step(at: Column, piece: Column) -> Column:
        depth = at["depth"] + F.when(piece.rlike(rf"(?i)^</{tag}\b"), -1).when(piece.rlike(rf"(?i)^<{tag}\b"), 1).otherwise(0)
        closes = (at["end"] < 0) & (depth == 0) & (at["read"] > 0)
        return F.struct(depth.alias("depth"), (at["read"] + F.length(piece)).alias("read"), F.when(closes, at["read"]).otherwise(at["end"]).alias("end"))

    return F.aggregate(tags, begin, step, lambda at: F.when(at["end"] < 0, at["read"]).otherwise(at["end"]))


def _cut(tail: Column, tag: str, take: Callable[[Column, Column, Column], Column]) -> Column:
    """``take(text, length of the start tag, place of the closing tag)`` of the element that the text begins with."""
    return let(tail, lambda t: let(F.struct(F.instr(t, ">").alias("start"), _end_of(t, tag).alias("end")), lambda e: take(t, e["start"], e["end"])))


def _inner(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def _rest(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, end + 1, F.length(text))


def _element_at_start(tail: Column, tag: str) -> Column:
    """(start tag, content, rest from the closing tag on) of the element that the text begins with."""
    return _cut(tail, tag, lambda t, s, e: F.struct(F.left(t, s).alias("start"), _inner(t, s, e).alias("inner"), _rest(t, s, e).alias("rest")))


def region(text: Column | str, tag: str, attribute: str = "", value: str = "") -> Column:
    """Content of the first such element up to its own closing tag; NULL without one."""
    return _cut(part(text, rf"(?is)({_start(tag, attribute, value)}.*)"), tag, _inner)


def regions(text: Column | str, tag: str, attribute: str, value: str) -> Column:
    """Contents of all such elements (one inside another counts by itself), as an array."""
    start = _start(tag, attribute, value)
    runs = F.filter(F.split(text, rf"(?is)(?={start})"), lambda p: p.rlike(rf"(?is)^{start}"))
    return F.transform(runs, lambda p: _cut(p, tag, _inner))


def without(text: Column | str, tag: str, attribute: str, value: str) -> Column:
    """The text with all such elements removed, nested content included."""
    start = _start(tag, attribute, value)
    rest = lambda p: F.regexp_replace(_cut(p, tag, _rest), r"(?i)^</[^>]*>", "")
    return F.array_join(F.transform(F.split(text, rf"(?is)(?={start})"), lambda p: F.when(p.rlike(rf"(?is)^{start}"), rest(p)).otherwise(p)), "")


def inner_text(markup: Column, separator: str = " ", closed: bool = False) -> Column:
    """Text nodes of a fragment, each trimmed, joined by the separator; entities resolved (``closed``: only those that end in a semicolon)."""
    joined = F.regexp_replace(markup, r"\s*<[^>]*>\s*(?:<[^>]*>\s*)*", separator)
    plain = F.btrim(joined, F.lit(" \t\n\r" + separator))
    return let(plain, lambda text: n.resolved(text, closed))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{00a0}]{2,}|[\t\n\x0b\f\r\x{00a0}]", " "))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double or single quotes or without any, entities resolved."""
    other = rf"""\s*+(?!{name}\s*=)[^\s=>"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+"""
    value = rf"""(?is)^<[^\s>]+(?:{other})*+\s*+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    bare = let(part(tag, value), lambda v: F.when(v.rlike("^[\"']"), filled(v.substr(F.lit(2), F.length(v) - 2))).otherwise(v))
    return let(bare, n.unescaped)


def _file(href: Column, strip_original: bool = False) -> Column:
    """Last path segment of an address held in an expression."""
    name = filled(F.substring_index(F.regexp_replace(href, r"[?#].*$", ""), "/", -1))
    return F.regexp_replace(name, r"-original(\.[^.]*)?$", "$1") if strip_original else name


# --- labelled cells --------------------------------------------------------------------------------------------------


def _rows(markup: Column | str) -> Column:
    return pieces(markup, r"(?is)<tr\b[^>]*>(.*?)</tr>")


def extract_fields(pages: DataFrame, html: str, labels: list[str], separator: str = "\n") -> DataFrame:
    """Long table (label, value): the cell after the first header cell holding the label, or after such a plain cell."""
    pages = pages.withColumn(html, canonical(html))

    def value(label: str) -> Column:
        # the label may lie inside child tags of its cell, the value may hold a table of its own
        child = r"(?:<(?!/?t[hdr]\b)[^>]*>[^<]*)*"
        after = [part(html, rf"(?is)<{h}\b[^>]*>[^<]*{child}?{re.escape(label)}[^<]*{child}</{h}>\s*(<td\b[^>]*>.*)") for h in ("th", "td")]
        return F.struct(F.lit(label).alias("label"), inner_text(_cut(F.coalesce(*after), "td", _inner), separator).alias("value"))

    found = pages.select("*", F.inline(F.array(*[value(label) for label in labels])))
    return found.drop(html).filter(F.coalesce("value", F.lit("")) != "")


def _feature_cells(html: str, section: str) -> Column:
    """Header and value of every row of the features section; tooltips are left out of the values."""
    rows = _rows(region(html, "section", "id", section))

    def cell(row: Column) -> Column:
        label = F.rtrim(F.lower(squeeze(inner_text(part(row, element("th"))))), F.lit(":"))
        markup = without(part(row, element("td")), "div", "class", "tooltip")
        return F.struct(F.trim(F.regexp_replace(label, "[^a-z0-9]+", "_"), F.lit("_")).alias("label"), squeeze(inner_text(markup)).alias("value"))

    return F.filter(F.transform(rows, cell), lambda c: c["label"].isNotNull() & c["value"].isNotNull())


def extract_feature_rows(pages: DataFrame, html: str, section: str = "fiche_caracteristiques") -> DataFrame:
    """Long table (label, value) of the features section."""
    pages = pages.withColumn(html, canonical(html))
    return pages.select(*[c for c in pages.columns if c != html], F.inline(_feature_cells(html, section)))


def extract_feature_table(pages: DataFrame, html: str, labels: list[str], section: str = "fiche_caracteristiques") -> DataFrame:
    """The same as one column per label (the last row wins), without a pivot."""
    pages = pages.withColumn(html, canonical(html))
    cells = pages.withColumn("_cells", _feature_cells(html, section))

    def last(label: str) -> Column:
        return F.try_element_at(F.filter("_cells", lambda c: c["label"] == label), F.lit(-1))["value"].alias(label)

    return cells.select(*[c for c in pages.columns if c != html], *[last(label) for label in labels])


def extract_title(pages: DataFrame, html: str, closed: bool = False) -> DataFrame:
    """Heading text up to its first span, and the span as subtitle; the heading of ``#main_title`` before any other.

    With ``closed``, an entity without its semicolon (a heading that was cut off) stays as it is.
    """
    pages = pages.withColumn(html, canonical(html))
    heading = F.coalesce(part(region(html, "div", "id", "main_title"), element("h1")), part(html, element("h1")))
    headed = pages.withColumn("_heading", heading)
    before = F.regexp_replace("_heading", r"(?is)<span\b.*$", "")
    return headed.select(
        *[c for c in pages.columns if c != html],
        filled(squeeze(inner_text(before, closed=closed))).alias("title"),
        filled(squeeze(inner_text(part("_heading", element("span")), closed=closed))).alias("subtitle"),
    )


def extract_links(pages: DataFrame, html: str, like: str = "%") -> DataFrame:
    """Anchors with their place in the page, address and text."""
    pages = pages.withColumn(html, canonical(html))
    links = F.arrays_zip(pieces(html, ANCHOR, 1).alias("href"), pieces(html, ANCHOR, 2).alias("inner"))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(links).alias("_pos", "_link"))
    wanted = rows.withColumn("href", n.unescaped(F.col("_link.href"))).filter(F.col("href").like(like))
    return wanted.select(*[c for c in rows.columns if c not in ("_pos", "_link")], (F.col("_pos") + 1).alias("ordinal"), "href", squeeze(inner_text(F.col("_link.inner"))).alias("text"))


# --- images ----------------------------------------------------------------------------------------------------------


def _picture_links(markup: Column, strip_original: bool = False) -> Column:
    """Files of the anchors that hold an image."""
    with_image = F.filter(pieces(markup, r"(?is)(<a\b[^>]*\bhref\b[^>]*>.*?</a>)"), lambda a: F.lower(a).contains("<img"))
    return F.transform(with_image, lambda a: _file(attribute(a, "href"), strip_original))


def _faces(files: Column) -> Column:
    """First and second file; one file serves for both faces."""
    return F.struct(F.get(files, F.lit(0)).alias("face_a"), F.coalesce(F.get(files, F.lit(1)), F.get(files, F.lit(0))).alias("face_b"))


def _reference_faces(html: str) -> Column:
    """Faces of the main pictures: two by place, otherwise by the ending of the image text or by place; last one wins."""
    anchors = pieces(html, r"""(?is)(<a\b[^>]*\bclass\s*=\s*["'][^"']*\bcoin_pic\b[^"']*["'][^>]*>.*?</a>)""")
    valid = F.filter(anchors, lambda a: F.lower(a).contains("<img") & ~a.rlike("no-obverse|no-reverse"))

    def kind(a: Column, i: Column, count: Column) -> Column:
        text = F.lower(F.coalesce(attribute(part(a, r"(?is)(<img\b[^>]*>)"), "alt"), F.lit("")))
        by_place = F.when(i == 0, "a").when(i == 1, "b")
        return F.struct(
            F.when(count == 2, by_place).when(text.endswith("obverse"), "a").when(text.endswith("reverse"), "b").otherwise(by_place).alias("face"),
            _file(attribute(a, "href"), True).alias("file"),
        )

    def last(marked: Column, face: str) -> Column:
        return F.try_element_at(F.filter(marked, lambda m: m["face"] == face), F.lit(-1))["file"]

    def faces(anchors: Column) -> Column:
        marked = F.transform(anchors, lambda a, i: kind(a, i, F.size(anchors)))
        return let(marked, lambda m: F.array(F.struct(last(m, "a").alias("face_a"), last(m, "b").alias("face_b"))))

    return let(valid, faces)


def extract_media(pages: DataFrame, html: str) -> DataFrame:
    """Image references: kind 1 reference, 2 example, 3 sale, ``edge`` and ``comment`` (source 2 when from the forum)."""
    pages = pages.withColumn(html, canonical(html))

    def typed(kind: str, faces: Column, source: Column | None = None) -> Column:
        return F.transform(faces, lambda f: F.struct(F.lit(kind).alias("kind"), f["face_a"].alias("face_a"), f["face_b"].alias("face_b"), f["source"].alias("source_type") if source is not None else F.lit(None).cast("int").alias("source_type")))

    def blocks(place: Column, tag: str, name: str) -> Column:
        found = F.coalesce(regions(place, tag, "class", name), F.array().cast("array<string>"))
        return F.filter(F.transform(found, lambda b: _faces(_picture_links(b))), lambda f: f["face_a"].isNotNull())

    edge_part = part(region(html, "section", "id", "fiche_descriptions"), r"(?is)<h3\b[^>]*>\s*edge[^<]*</h3>(.*?)(?:<h3\b|</section>|$)")
    edge = F.coalesce(F.get(_picture_links(edge_part, True), F.lit(0)), _file(attribute(part(edge_part, r"(?is)(<img\b[^>]*>)"), "src"), True))
    edges = F.when(edge.isNotNull(), F.array(F.struct(edge.alias("face_a"), edge.alias("face_b")))).otherwise(F.array().cast("array<struct<face_a:string,face_b:string>>"))
    linked = pieces(F.coalesce(region(html, "div", "id", "fiche_comments"), F.lit("")), r"(?is)(<a\b[^>]*\bhref\b[^>]*>.*?</a>)")
    comments = F.filter(linked, lambda a: F.lower(a).contains("<img"))
    comment_rows = F.transform(
        comments, lambda a: F.struct(_file(attribute(a, "href")).alias("face_a"), F.lit(None).cast("string").alias("face_b"), F.when(attribute(a, "href").contains("/forum/images/"), 2).otherwise(1).alias("source"))
    )
    everything = F.concat(
        typed("1", _reference_faces(html)), typed("2", blocks(region(html, "div", "id", "examples_list"), "div", "example_image")),
        typed("3", blocks(region(html, "table", "id", "sales_list"), "td", "sale_pictures")), typed("edge", edges),
        typed("comment", F.filter(comment_rows, lambda c: c["face_a"].isNotNull()), F.lit(1)),
    )
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(everything).alias("_pos", "_m"))
    return rows.select("*", (F.col("_pos") + 1).alias("ordinal"), "_m.*").drop("_pos", "_m")


# --- tables with one or two header rows ------------------------------------------------------------------------------


def extract_mintage(pages: DataFrame, html: str) -> DataFrame:
    """Rows of the table below the mintage heading; a spanning header cell takes its names from the second header row."""
    pages = pages.withColumn(html, canonical(html))
    table = part(html, r"(?is)<h3\b[^>]*>[^<]*mintage[^<]*</h3>.*?(<table\b.*?</table>)")
    work = pages.withColumn("_table", table).withColumn("_head", _rows(part("_table", element("thead"))))
    cells = r"(?is)(<t[hd]\b[^>]*>.*?</t[hd]>)"
    name = lambda c: F.lower(squeeze(inner_text(c)))
    work = work.withColumn("_top", pieces(F.get("_head", F.lit(0)), cells)).withColumn("_sub", F.transform(pieces(F.get("_head", F.lit(1)), cells), name))

    def take(acc: Column, cell: Column) -> Column:
        span = F.coalesce(attribute(cell, "colspan").cast("int"), F.lit(1))
        spread = name(cell).rlike(r"\bmintage\b") & (span > 1) & (F.size("_head") > 1)
        return F.struct(
            F.when(spread, acc["used"] + span).otherwise(acc["used"]).alias("used"),
            F.concat(acc["names"], F.when(spread, F.slice("_sub", acc["used"] + 1, span)).otherwise(F.array(name(cell)))).alias("names"),
        )

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("names"))
    work = work.withColumn("_names", F.aggregate("_top", start, take, lambda acc: acc["names"]))
    words = ("year", "mint", "mark", "unc", "bu", "proof")

    def place(word: str) -> Column:
        return F.array_position(F.transform("_names", lambda h: h.rlike(rf"\b{word}\b")), True).cast("int").alias(word)

    work = work.withColumn("_at", F.struct(*[place(w) for w in words]))
    body = work.withColumn("_row", F.explode(_rows(part("_table", element("tbody"))))).withColumn("_cells", pieces("_row", cells))

    def cell(word: str) -> Column:
        index = F.col(f"_at.{word}")
        text = squeeze(inner_text(F.get("_cells", index - 1)))
        return F.when(index > 0, let(text, lambda x: F.when(~F.lower(x).contains("unknown"), x)))

    words, numbers = {"mint": cell("mint"), "mark": cell("mark")}, {w: cell(w) for w in ("year", "unc", "bu", "proof")}
    as_number = lambda c: filled(F.regexp_replace(c, "[^0-9]", "")).try_cast("bigint")
    rows = body.select(
        *[c for c in pages.columns if c != html], *[F.coalesce(c, F.lit("")).alias(w) for w, c in words.items()], *[as_number(c).alias(w) for w, c in numbers.items()]
    )
    return rows.filter("coalesce(year, unc, bu, proof) IS NOT NULL OR mint <> '' OR mark <> ''")


def extract_face(pages: DataFrame, html: str, label: str) -> DataFrame:
    """Themes, description with its theme key, legends, creators and reference image of one face."""
    pages = pages.withColumn(html, canonical(html))
    table = part(html, rf"(?is)<h3\b[^>]*>\s*{label}\s*:?\s*</h3>.*?(<table\b[^>]*\bcoin-desc\b[^>]*>.*?</table>)")
    work = pages.withColumn("_t", table)

    def after(name: str) -> Column:
        return part("_t", rf"(?is)<p\b[^>]*>\s*<span\b[^>]*>\s*{name}\s*</span>(.*?)</p>")

    lines = F.transform(F.split(F.regexp_replace(after("Legend"), r"(?i)<br\s*/?>", "\n"), "\n"), lambda x: squeeze(inner_text(x)))
    image = attribute(part(part("_t", r"(?is)<tr\b[^>]*>\s*<th\b[^>]*>(.*?)</th>"), r"(?is)(<img\b[^>]*>)"), "src")
    return work.select(
        *[c for c in pages.columns if c != html],
        F.transform(pieces("_t", element("span", "class", "theme")), lambda s: squeeze(inner_text(s))).alias("themes"),
        squeeze(inner_text(after("Description"))).alias("description"),
        part(after("Description"), r"""[?&;]theme=([^&"'#]+)""").alias("description_key"),
        F.coalesce(F.filter(lines, lambda x: x != ""), F.array().cast("array<string>")).alias("legends"),
        squeeze(inner_text(after("Creators?:"))).alias("creators"),
        F.when(~F.lower(image).contains("noimage"), image).alias("reference_image"),
    )


def extract_period_sections(pages: DataFrame, html: str) -> DataFrame:
    """Listing page: every header opens a period and the result links up to the next header belong to it."""
    pages = pages.withColumn(html, canonical(html))
    sections = F.slice(F.split(html, r"(?i)<header\b"), 2, 2_000_000_000)
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(sections).alias("_pos", "_s"))
    head, tail = F.substring_index("_s", "</header>", 1), F.col("_s").substr(F.instr("_s", "</header>"), F.length("_s"))
    # result anchors: the address inside <strong> of a description piece
    hrefs = pieces(tail, r"""(?is)\bdescription_piece\b[^>]*>.*?<strong>\s*<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']""")
    kept = rows.select(
        "*", (F.col("_pos") + 1).alias("period_no"), squeeze(inner_text(part(head, element("h2")))).alias("period"),
        squeeze(inner_text(part(head, element("p")))).alias("units"), F.posexplode_outer(F.transform(hrefs, n.unescaped)).alias("_i", "href"),
    )
    return kept.withColumn("link_no", F.col("_i") + 1).drop("_pos", "_s", "_i")


def extract_after_label(pages: DataFrame, html: str, label: str, tag: str = "strong") -> DataFrame:
    """Text of the next strong element after a label, and its number when it is one."""
    pages = pages.withColumn(html, canonical(html))
    text = squeeze(inner_text(part(html, rf"(?is){re.escape(label)}.*?<{tag}\b[^>]*>(.*?)</{tag}>")))
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    return pages.select(*[c for c in pages.columns if c != html], text.alias("value"), number.alias("number"))


# What to cut from a saved page, in order.
BOILERPLATE = (
    (r"(?is)(<head\b[^>]*>).*?(</head>)", "$1$2"),
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?is)<nav\b.*?</nav>", ""),
    (r"(?is)<footer\b.*?</footer>", ""),
    (r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']https?://[^"']*/design/[^"']*["'][^>]*>""", ""),
)


# Elements that go with all they hold, as (tag, attribute, value).
BOILERPLATE_BLOCKS = (
    ("header", "id", "global_header"),
    ("div", "class", "ad"),
    ("div", "id", "sale_offers"),
    ("section", "id", "sale_offers"),
    ("div", "id", "fiche_echanges"),
    ("section", "id", "fiche_echanges"),
    ("span", "class", "translated_info"),
)


def strip_boilerplate(pages: DataFrame, html: str, rules=BOILERPLATE, blocks=BOILERPLATE_BLOCKS) -> DataFrame:
    """Documents without their frame, advertising, scripts and exchange offers; ``#middle_element`` keeps only its ``main#main``."""
    cleaned = pages
    for pattern, replacement in rules:
        cleaned = cleaned.withColumn(html, F.regexp_replace(html, pattern, replacement))
    for block in blocks:
        start = rf"(?is){_start(*block)}"
        cleaned = cleaned.withColumn(html, F.when(F.col(html).rlike(start), without(html, *block)).otherwise(F.col(html)))
    middle = part(html, rf"(?is)({_start('div', 'id', 'middle_element')}.*)")

    def only_main(tail: Column, cut: Column) -> Column:
        main = _element_at_start(part(cut["inner"], rf"(?is)({_start('main', 'id', 'main')}.*)"), "main")
        before = F.left(F.col(html), F.length(html) - F.length(tail))
        return let(main, lambda m: F.concat(before, cut["start"], m["start"], m["inner"], F.lit("</main>"), cut["rest"]))

    kept = let(middle, lambda tail: let(_element_at_start(tail, "div"), lambda cut: only_main(tail, cut)))
    return cleaned.withColumn(html, F.coalesce(kept, F.col(html)))


# --- rewriting -------------------------------------------------------------------------------------------------------


def rewrite_refs(docs: DataFrame, key: str, html: str, mapping: DataFrame, map_key: str, old: str, new: str) -> DataFrame:
    """Replace file names in documents by a mapping table; swaps are safe because all names change at once.

    The names a document refers to are cut out first and joined with the mapping, so what is collected per document is
    bounded by the document itself.
    """
    named = F.array_distinct(F.transform(pieces(html, r"""(?i)\b(?:src|href)\s*=\s*["']([^"']+)["']"""), lambda u: F.substring_index(u, "/", -1)))
    used = docs.select(F.col(key).alias("_doc"), F.explode(named).alias("_name"))
    changes = mapping.groupBy(F.col(map_key).alias("_mdoc"), F.col(old).alias("_old")).agg(F.min(new).alias("_new"))
    hits = used.join(changes, (F.col("_doc") == F.col("_mdoc")) & (F.col("_name") == F.col("_old")))
    # longest names first, so that no name is cut by a shorter one it contains
    per_doc = hits.groupBy("_doc").agg(F.sort_array(F.collect_list(F.struct((-F.length("_old")).alias("l"), F.col("_old").alias("o"), F.col("_new").alias("n")))).alias("_m"))
    token = lambda i: F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002"))
    steps = F.transform("_m", lambda m, i: F.struct(m["o"].alias("o"), m["n"].alias("n"), token(i).alias("t")))
    marked = F.aggregate("_s", F.col(html), lambda text, m: F.replace(text, m["o"], m["t"]))
    final = F.aggregate("_s", F.col("_marked"), lambda text, m: F.replace(text, m["t"], m["n"]))
    joined = docs.join(per_doc, F.col(key) == F.col("_doc"), "left").withColumn("_s", steps).withColumn("_marked", marked)
    return joined.withColumn(html, F.when(F.col("_m").isNull(), F.col(html)).otherwise(final)).select(*docs.columns)


def remove_block(docs: DataFrame, html: str, needle: str, opening: str, closing: str) -> DataFrame:
    """Delete the smallest block around the first needle; a document without it stays as it is."""
    # capitals of A-Z only: lower-casing others can change the length of the text
    plain = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = plain(F.col(html))
    at = F.instr(low, needle.lower())
    before = F.left(F.col(html), at - 1)
    tail = F.instr(F.reverse(plain(before)), opening[::-1].lower())
    start = at - tail - len(opening) + 1
    end = F.call_function("locate", F.lit(closing.lower()), low, F.greatest(at, F.lit(1)))
    cut = F.concat(F.left(F.col(html), start - 1), F.col(html).substr(end + len(closing), F.length(html)))
    return docs.withColumn(html, F.when((at > 0) & (tail > 0) & (end > 0), cut).otherwise(F.col(html)))


def classify_segments(docs: DataFrame, text: str, separator: str = r"(?i)<br\s*/?\s*><br\s*/?\s*>") -> DataFrame:
    """Segments between double line breaks: image group, copyright line or text; empty ones are dropped."""
    read = lambda s: F.struct(F.lower(s).contains("<img").alias("image"), squeeze(inner_text(s)).alias("content"))
    rows = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.transform(F.split(text, separator), read)).alias("_pos", "_s"))
    kind = F.when(F.col("_s.image"), "image_group").when(F.col("_s.content").startswith("©"), "copyright").when(F.col("_s.content") != "", "text")
    return rows.select("*", kind.alias("kind"), F.col("_s.content").alias("content"), (F.col("_pos") + 1).alias("segment_no")).filter("kind IS NOT NULL").drop("_pos", "_s")


def extract_people(pages: DataFrame, html: str, label: str = "Engravers?") -> DataFrame:
    """Names of a labelled paragraph, linked or separated by commas, with address and artist id."""
    pages = pages.withColumn(html, canonical(html))
    after = part(html, rf"(?is)<p\b[^>]*>\s*<strong\b[^>]*>\s*{label}\s*:?\s*</strong>(.*?)</p>")
    # only anchors tell names apart, other tags are formatting
    plain = F.regexp_replace(after, r"(?i)</?(?!a[\s>])[a-z][^>]*>", "")
    runs = pieces(plain, r"(?is)(<a\b[^>]*>.*?</a>|[^<]+)")
    nobody = "array<struct<name:string,href:string>>"

    def people(run: Column) -> Column:
        linked = F.array(F.struct(squeeze(inner_text(run)).alias("name"), attribute(run, "href").alias("href")))
        listed = F.transform(F.split(run, ","), lambda s: F.struct(squeeze(s).alias("name"), F.lit(None).cast("string").alias("href")))
        return F.when(F.lower(run).startswith("<a"), linked.cast(nobody)).otherwise(listed.cast(nobody))

    found = F.filter(F.flatten(F.transform(runs, people)), lambda p: p["name"] != "")
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("_pos", "_p"))
    artist = F.when(F.col("_p.href").contains("artist.php"), filled(F.regexp_extract("_p.href", r"[?&]id=([0-9]+)", 1)).try_cast("bigint"))
    return rows.select("*", (F.col("_pos") + 1).alias("person_no"), "_p.name", "_p.href", artist.alias("artist_id")).drop("_pos", "_p")


def extract_letterings(pages: DataFrame, html: str) -> DataFrame:
    """Lines of the lettering paragraph."""
    pages = pages.withColumn(html, canonical(html))
    after = part(html, r"(?is)<p\b[^>]*>\s*<strong\b[^>]*>\s*Lettering[^<]*</strong>(.*?)</p>")
    block = F.coalesce(part(after, element("span", "class", "lettering")), after)
    lines = F.filter(F.transform(F.split(F.regexp_replace(block, r"(?i)<br\s*/?>", "\n"), "\n"), lambda x: squeeze(inner_text(x))), lambda x: x != "")
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(lines).alias("_pos", "line"))
    return rows.withColumn("line_no", F.col("_pos") + 1).drop("_pos")


# --- directory pages -------------------------------------------------------------------------------------------------


def extract_directory(pages: DataFrame, html: str, kind: str) -> DataFrame:
    """List items of a directory page: ``mints``, ``tags``, ``techniques`` or ``rulers``."""
    pages = pages.withColumn(html, canonical(html))
    keep = [c for c in pages.columns if c != html]
    items = pages.select(*keep, F.explode(pieces(html, element("li"))).alias("_li"))
    script = {"mints": "mint", "techniques": "technique", "rulers": "ruler"}.get(kind)
    if script:
        anchor = part("_li", rf"""(?is)(<a\b[^>]*\bhref\s*=\s*["'][^"']*{script}\.php[^"']*["'][^>]*>.*?</a>)""")
        items = items.withColumn("_a", anchor).filter("_a IS NOT NULL").withColumn("_href", attribute(F.col("_a"), "href"))
    if kind == "mints":
        rest = F.regexp_replace(squeeze(inner_text(F.regexp_replace("_a", element("strong"), ""))), r"^\s*,\s*", "")
        items = items.withColumn("_rest", rest).withColumn("_at", n.extract_lat_lon("_li"))
        return items.select(
            *keep, n.url_param_id("_href", "id").alias("id"), squeeze(inner_text(part("_a", element("strong")))).alias("name"),
            filled(F.trim(F.regexp_replace("_rest", r"\(([^)]+)\)\s*$", ""))).alias("location"),
            F.trim(part("_rest", r"\(([^)]+)\)\s*$")).alias("period"), "_at.latitude", "_at.longitude",
        )
    if kind == "techniques":
        path = part("_li", r"""(?is)<img\b[^>]*\bsrc\s*=\s*["'][^"']*?/photos(/[^"'?#]*)""")
        return items.select(*keep, n.url_param_id("_href", "id").alias("id"), squeeze(inner_text(F.col("_a"))).alias("name"), path.alias("image"))
    if kind == "rulers":
        years = filled(squeeze(inner_text(part("_a", element("em")))))
        name = F.trim(F.regexp_replace(squeeze(inner_text(F.col("_a"))), r"\s*\([^)]*\)\s*$", ""))
        return items.select(*keep, n.url_param_id("_href", "id").alias("id"), name.alias("name"), years.alias("years"))
    if kind == "tags":
        anchor = part(part("_li", element("strong")), r"(?is)(<a\b.*?</a>)")
        items = items.withColumn("_href", attribute(anchor, "href")).withColumn("_name", filled(squeeze(inner_text(anchor))))
        image = part("_li", r"""(?is)<img\b[^>]*\bsrc\s*=\s*["'][^"']*?catalogue/photos/([^"']*)""")
        info = filled(squeeze(inner_text(part("_li", element("p")))))
        return items.select(*keep, n.url_param_id("_href", "k[]").alias("id"), F.col("_name").alias("name"), info.alias("info"), image.alias("image"))
    raise ValueError(f"unknown directory {kind!r}")


def no_result_pages(pages: DataFrame, html: str) -> DataFrame:
    """State of a fetched page: ``empty``, ``blocked``, ``challenge`` or ``ok``."""
    has = lambda *words: [F.col(html).contains(w) for w in words]
    oops, ip, blocked = has("Oops!", "your IP", "blocked")
    checking, scripts = has("Checking connection", "Enable JavaScript and cookies to continue")
    empty = F.col(html).rlike(r"""(?is)<p\b[^>]*\bclass\s*=\s*["'][^"']*\bno-result\b""")
    state = F.when(checking & scripts, "challenge").when(oops & ip & blocked, "blocked").when(empty, "empty").otherwise("ok")
    return pages.withColumn("state", state)


def flatten_annotations(rows: DataFrame) -> DataFrame:
    """Annotation export → one row per mask: item, image address, class name, mask address; objects without mask dropped."""
    labels = F.flatten(F.transform(F.map_values("projects"), lambda p: F.coalesce(p["labels"], F.array())))
    objects = F.flatten(F.transform(labels, lambda label: F.coalesce(label["annotations"]["objects"], F.array())))
    flat = rows.select(
        F.coalesce(F.nullif("data_row.external_id", F.lit("")), F.col("data_row.id")).alias("item"), F.coalesce(F.nullif("data_row.row_data", F.lit("")), F.col("row_data")).alias("image_url"),
        F.posexplode(objects).alias("_pos", "_o"),
    )
    name = F.coalesce(F.nullif("_o.name", F.lit("")), F.nullif("_o.value", F.lit("")), F.lit("object"))
    masked = flat.select("item", "image_url", (F.col("_pos") + 1).alias("object_no"), name.alias("class_name"), F.col("_o.mask.url").alias("mask_url"))
    return masked.filter(F.coalesce("mask_url", F.lit("")) != "")


# --- nested lists: the one extraction that needs a stack --------------------------------------------------------------

NODE_SCHEMA = (
    "position int, raw_slug string, slug string, raw_name string, name string, territory string, alt_names string, tags array<string>,"
    " parent_slug string, raw_parent_slug string, historical boolean"
)


_LIST_TOKEN = re.compile(r"<(/?)(li|a|em|span)\b([^>]*)>|<[^>]*>|([^<]+)", re.IGNORECASE)
_LIST_ATTRIBUTE = re.compile(r"""\b(class|href)\s*=\s*["']([^"']*)["']""", re.IGNORECASE)


def _read_list(markup: str) -> list[dict]:
    """One record per list item; the stack of open items gives the parent."""
    records, stack, field = [], [], None
    for closing, tag, inside, text in _LIST_TOKEN.findall(markup):
        if text:
            if stack and field:
                stack[-1][field] += f" {html.unescape(text)}"
            continue
        tag = tag.lower()
        if closing:
            if tag == "li" and stack:
                stack.pop()
            field = "raw_name" if tag == "em" and field == "territory" else None if tag in ("a", "span") else field
            continue
        given = dict(_LIST_ATTRIBUTE.findall(inside)) if tag else {}
        classes = given.get("class", "").split()
        if tag == "li":
            above = stack[-1] if stack else {}
            stack.append({
                "position": len(records) + 1, "raw_slug": None, "slug": None, "raw_name": "", "territory": "", "alt_names": "", "historical": False,
                "tags": [c for c in classes if c.startswith("tag_")], "parent_slug": above.get("slug"), "raw_parent_slug": above.get("raw_slug"),
            })
            records.append(stack[-1])
        elif stack and tag == "a" and "name" in classes:
            found = re.search(r"/catalogue/([^/]+)\.html", given.get("href", ""))
            if found:
                stack[-1].update(raw_slug=found[1], slug=re.sub(r"-\d+$", "", found[1]))
            stack[-1]["historical"] = "historical_period" in classes
            field = "raw_name"
        elif tag == "em" and field == "raw_name":
            field = "territory"
        elif stack and tag == "span" and "alt_names" in classes:
            field = "alt_names"
    return records


def flatten_nested_list(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Nested list markup → one row per node with its parent's slug, tags, other names, territory and period flag."""

    columns = [key, *[f.split()[0] for f in NODE_SCHEMA.split(", ")]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for page, text in zip(batch[key], batch[markup], strict=True):
                for record in _read_list(text or ""):
                    texts = [" ".join(record[f].split()) or None for f in ("raw_name", "territory", "alt_names")]
                    name = (texts[0] or "").rstrip(",").strip() or None
                    rows.append((page, record["position"], record["raw_slug"], record["slug"], texts[0], name, *texts[1:], record["tags"], record["parent_slug"], record["raw_parent_slug"], record["historical"]))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    source = pages.select(key, markup)
    return source.mapInPandas(read, f"{key} {dict(source.dtypes)[key]}, {NODE_SCHEMA}")
