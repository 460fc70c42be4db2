"""Markup as a tolerant reader sees it, rewritten so that flat patterns find what a tree would hold.

``canonical`` is one SQL expression, used by the extraction operators and inside SQL functions:

- comments, scripts and styles go, whether they are closed or not;
- ``<`` and ``>`` inside quoted attributes become entities, so a tag ends at its first ``>``;
- a table inside a cell keeps its text, but its tags are renamed (``x-table``, ``x-tr``, ...), so the rows and cells of a table
  are its own;
- cells and rows whose end tags are left out get them where the next cell, row, section or the table's end implies it.

Every step is a pass over the text inside its row; a page without such markup is only searched for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RAW = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
# \x27 is the apostrophe, which cannot stand in a raw SQL string
_VALUE_SIGN = r"=\s*(?:\x22[^\x22<>]*[<>]|\x27[^\x27<>]*[<>])"
_QUOTED_SIGN = rf"<[a-zA-Z/][^<>]*{_VALUE_SIGN}"
_TOKEN = r"</?[a-zA-Z](?:[^>\x22\x27]++|\x22[^\x22]*+\x22|\x27[^\x27]*+\x27)*+>|[^<]++|<"
_PARTS = "table|thead|tbody|tfoot|tr|td|th"
_AFTER = r"(?=[\s>/])"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _holds(text: str, *tags: str) -> str:
    """Whether one of the tags may begin in the text: a search for bytes, many times cheaper than a pattern."""
    return "(" + " OR ".join(f"contains(lower({text}), '{tag}')" for tag in tags) + ")"


def _without_raw(text: str) -> str:
    return f"CASE WHEN {_holds(text, '<!--', '<script', '<style')} THEN regexp_replace({text}, r'{_RAW}', '') ELSE {text} END"


def _quoted_signs(text: str) -> str:
    inner = "substr(t, 2, length(t) - 2)"
    tag = f"CASE WHEN t RLIKE r'(?s)^<.*[<>].' THEN concat('<', replace(replace({inner}, '>', '&gt;'), '<', '&lt;'), '>') ELSE t END"
    whole = f"array_join(transform(regexp_extract_all({text}, r'{_TOKEN}', 0), t -> {tag}), '')"
    # the first test looks only behind equals signs; the second one looks back and forth in every tag
    return f"CASE WHEN {text} RLIKE r'{_VALUE_SIGN}' AND {text} RLIKE r'{_QUOTED_SIGN}' THEN {whole} ELSE {text} END"


def _inner_tables(text: str) -> str:
    """Renames the parts of tables that lie in another; ``depths[i]`` is how many tables are open behind the i-th tag."""
    step = r"CASE WHEN p RLIKE r'(?i)^<table' THEN 1 WHEN p RLIKE r'(?i)^</table' THEN -1 ELSE 0 END"
    depths = f"slice(aggregate(parts, array(0), (done, p) -> concat(done, array(greatest(element_at(done, -1) + {step}, 0)))), 2, size(parts))"
    renamed = rf"regexp_replace(p, r'(?i)<(/?)({_PARTS}){_AFTER}', '<$1x-$2')"
    closed = r"regexp_replace(p, r'(?i)^</table', '</x-table')"
    part = f"CASE WHEN depths[i] > 1 THEN {renamed} WHEN depths[i] = 1 AND p RLIKE r'(?i)^</table' THEN {closed} ELSE p END"
    joined = f"array_join(transform(parts, (p, i) -> {part}), '')"
    parts = rf"split({text}, r'(?i)(?=</?table{_AFTER})')"
    return _let(parts, "parts", f"CASE WHEN size(parts) < 4 THEN {text} ELSE {_let(depths, 'depths', joined)} END")


# a cell that the next part of a table follows before its end, and a row that another row or the table's end follows
_OPEN_CELL = rf"(?i)<t[dh]{_AFTER}(?:[^<]++|<(?!/?(?:{_PARTS}){_AFTER}))*+<(?!/t[dh]{_AFTER})|<t[dh]{_AFTER}(?:[^<]++|<(?!/?(?:{_PARTS}){_AFTER}))*+\z"
_OPEN_ROW = rf"(?i)</t[dh]\s*>\s*(?:<(?:tr|/?(?:table|thead|tbody|tfoot)){_AFTER}|\z)"


def _implied_ends(text: str) -> str:
    """Leaves out the end tags of cells and rows and puts them where the next part of the table is. A table tag is added at
    the end and taken away again, so that the last row ends too. Nothing is done where none is missing."""
    bare = rf"regexp_replace({text}, r'(?i)</(?:td|th|tr)\s*>', '')"
    kinds = rf"transform(parts, p -> lower(regexp_extract(p, r'(?i)^<(td|th|tr){_AFTER}', 1)))"
    ends = "CASE kinds[i - 1] WHEN 'td' THEN '</td></tr>' WHEN 'th' THEN '</th></tr>' WHEN 'tr' THEN '</tr>' ELSE '' END"
    cell = "CASE kinds[i - 1] WHEN 'td' THEN '</td>' WHEN 'th' THEN '</th>' ELSE '' END"
    before = f"CASE WHEN i = 0 THEN '' WHEN kinds[i] IN ('td', 'th') THEN {cell} ELSE {ends} END"
    parts = rf"split(concat({bare}, '<table >'), r'(?i)(?=</?(?:{_PARTS}){_AFTER})')"
    joined = _let(kinds, "kinds", f"array_join(transform(parts, (p, i) -> concat({before}, p)), '')")
    closed = _let(parts, "parts", _let(joined, "whole", "left(whole, length(whole) - 8)"))
    return f"CASE WHEN {text} RLIKE r'{_OPEN_CELL}' OR {text} RLIKE r'{_OPEN_ROW}' THEN {closed} ELSE {text} END"


def canonical_sql(text: str) -> str:
    """The SQL expression; ``text`` is the name of a column, parameter or lambda variable."""
    tables = f"CASE WHEN {_holds('b', '<table')} AND b RLIKE r'(?i)<table{_AFTER}' THEN {_let(_inner_tables('b'), 'c', _implied_ends('c'))} ELSE b END"
    return _let(_without_raw(text), "a", _let(_quoted_signs("a"), "b", tables))


def canonical(column: str) -> Column:
    return F.expr(canonical_sql(f"`{column}`"))
