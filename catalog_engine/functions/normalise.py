"""Text normalisers.

Each one takes SQL expressions (a column name is enough), builds one SQL expression and returns it as a Column, so it stays
inside generated JVM code and filters on it can be pushed around by the optimiser. ``REGISTRY`` keeps the recipe, from
which ``catalog.register_functions`` makes SQL functions of the same names.
"""

from __future__ import annotations

import html.entities
import unicodedata
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog_engine.functions.arrays import let


@dataclass(frozen=True)
class Recipe:
    build: Callable[..., str]
    params: tuple[str, ...]
    returns: str


REGISTRY: dict[str, Recipe] = {}

# runs of white space that are not one plain space already, so ordinary text needs no replacement
WHITE = r"\s{2,}|[\t\n\x0b\f\r]"


def normaliser(params: str, returns: str = "STRING"):
    """Register ``build(sql, ...) -> sql`` under its name and wrap it as ``name(sql, ...) -> Column``."""

    def decorate(build: Callable[..., str]):
        REGISTRY[build.__name__] = Recipe(build, tuple(p.strip() for p in params.split(",")), returns)

        def as_column(*args, **kwargs) -> Column:
            return F.expr(build(*args, **kwargs))

        as_column.__name__ = build.__name__
        as_column.__doc__ = build.__doc__
        as_column.sql = build
        return as_column

    return decorate


def literal(text: str) -> str:
    """A SQL string literal for arbitrary text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- rule-built character tables -------------------------------------------------------------------------------------

_SCAN = [*range(0xC0, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)]


def _base_letters() -> tuple[str, str]:
    """Every accented character whose canonical decomposition starts with a Latin letter, and that letter."""
    source, target = [], []
    for code in [*_SCAN, 0x212A, 0x212B]:
        first = unicodedata.normalize("NFD", chr(code))[0]
        if first != chr(code) and first.isascii() and first.isalpha():
            source.append(chr(code))
            target.append(first)
    return "".join(source), "".join(target)


def _ascii_forms() -> tuple[tuple[str, str], dict[str, str]]:
    """Compatibility decompositions to ASCII: one-letter ones, and longer ones such as fractions or ligatures."""
    source, target, longer = [], [], {}
    for code in sorted({*range(0xA0, 0xC0), *_SCAN}):
        char = chr(code)
        form = unicodedata.normalize("NFKD", char).replace("⁄", "_")
        form = form.encode("ascii", "ignore").decode("ascii")
        if len(form) == 1 and form != char:
            source.append(char)
            target.append(form)
        elif len(form) > 1:
            longer[char] = form
    return ("".join(source), "".join(target)), longer


def _ranges(chars) -> str:
    """Character class body of a few ranges that cover the characters; a long class matches slowly.

    Gaps are covered as well, so a hit only says that a closer look is worth it.
    """
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and code < out[-1][1] + 48:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


_FOLD_FROM, _FOLD_TO = _base_letters()
(_ASCII_FROM, _ASCII_TO), _ASCII_LONG = _ascii_forms()


def _as_map(entries: dict[str, str]) -> str:
    """A constant map; the optimiser folds it once."""
    body = "\u0002".join(f"{k}\u0001{v}" for k, v in entries.items())
    return f"str_to_map({literal(body)}, '\u0002', '\u0001')"


#: lists that the names of entities are dealt into: a map of all 2,231 would be searched from its start for each entity
_NAME_LISTS = 512


def _dealt_names() -> str:
    """A constant array of lists, each name with its text in the list of its checksum; the optimiser folds it once."""
    lists = ["\u0002"] * _NAME_LISTS
    for name, text in html.entities.html5.items():
        lists[zlib.crc32(name.encode()) % _NAME_LISTS] += f"{name}\u0001{text}\u0002"
    return f"split({literal(chr(3).join(lists))}, '\u0003')"


def _named(piece: str) -> str:
    """The text of a named entity, or the piece itself when there is no such name."""
    name = f"substr({piece}, 2)"
    held = f"element_at({_dealt_names()}, CAST(crc32(CAST({name} AS BINARY)) % {_NAME_LISTS} AS INT) + 1)"
    mark = f"concat('\u0002', {name}, '\u0001')"
    found = f"substring_index(substring_index(x.held, x.mark, -1), '\u0002', 1)"
    return f"transform(array(named_struct('held', {held}, 'mark', {mark})), x -> CASE WHEN contains(x.held, x.mark) THEN {found} ELSE {piece} END)[0]"


def _ascii(c: str) -> str:
    """As many bytes as characters."""
    return f"octet_length({c}) = length({c})"


# --- I1 to I4 --------------------------------------------------------------------------------------------------------


def unescape_sql(c: str, closed: bool = False) -> str:
    """Named and numeric entities: cut the text into entities and other runs, replace the entities, join again.

    All names of the HTML standard; those that it allows without a semicolon are also known without one, unless only
    ``closed`` ones count.
    """
    end = ";" if closed else ";?"
    pieces = f"regexp_extract_all({c}, r'(&#?[A-Za-z0-9]+;?|[^&]+|&)', 1)"
    number = "CASE WHEN lower(substr(p, 3, 1)) = 'x' THEN try_cast(conv(substr(p, 4, length(p) - 4), 16, 10) AS BIGINT) ELSE try_cast(substr(p, 3, length(p) - 3) AS BIGINT) END"
    numeric = f"try_cast(decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32') AS STRING)"
    piece = (
        f"CASE WHEN p RLIKE r'^&#([0-9]{{1,7}}|[xX][0-9A-Fa-f]{{1,6}});$' THEN coalesce({numeric}, '\ufffd')"
        f" WHEN p RLIKE r'^&[A-Za-z][A-Za-z0-9]*{end}$' THEN {_named('p')}"
        " ELSE p END"
    )
    return f"CASE WHEN instr({c}, '&') = 0 THEN {c} ELSE array_join(transform({pieces}, p -> {piece}), '') END"


def unescaped(text: Column) -> Column:
    """Entities resolved as in ``clean_text``, for a column that has no name."""
    return resolved(text, False)


def resolved(text: Column, closed: bool) -> Column:
    """The same; with ``closed`` only entities that end in a semicolon."""
    end = ";" if closed else ";?"
    names = F.expr(_dealt_names())

    def named(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2))
        held = F.element_at(names, (F.crc32(name.cast("binary")) % _NAME_LISTS).cast("int") + 1)
        mark = F.concat(F.lit("\u0002"), name, F.lit("\u0001"))
        behind = lambda x: F.call_function("substring_index", x["held"], x["mark"], F.lit(-1))
        at = F.struct(held.alias("held"), mark.alias("mark"))
        return let(at, lambda x: F.when(F.contains(x["held"], x["mark"]), F.substring_index(behind(x), "\u0002", 1)).otherwise(piece))

    def resolve(piece: Column) -> Column:
        hexadecimal = F.lower(F.substring(piece, 3, 1)) == "x"
        digits = F.regexp_extract(piece, r"[0-9A-Fa-f]+(?=;)", 0)
        code = F.when(hexadecimal, F.conv(digits, 16, 10).try_cast("bigint")).otherwise(digits.try_cast("bigint"))
        char = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(piece.rlike(r"^&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});$"), char).when(piece.rlike(rf"^&[A-Za-z][A-Za-z0-9]*{end}$"), named(piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(r"(&#?[A-Za-z0-9]+;?|[^&]+|&)"), F.lit(1))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, resolve), "")).otherwise(text)


@normaliser("s")
def clean_text(c: str, closed: bool = False) -> str:
    """Unescape entities, make special spaces plain, fraction slash to slash, collapse white space, trim.

    With ``closed``, an entity without its semicolon (a text that was cut off) stays as it is.
    """
    # No-break, narrow no-break, thin, figure, em and ideographic space, word joiner, byte order mark; then the
    # fraction slash.
    special, plain = "\u00a0\u202f\u2009\u2007\u2003\u3000\u2060\ufeff\u2044", "        /"
    return rf"trim(regexp_replace(translate({unescape_sql(c, closed)}, '{special}', '{plain}'), r'{WHITE}', ' '))"


@normaliser("s")
def fold_text(c: str) -> str:
    """Accent fold, lower case, everything but letters and digits becomes one space."""
    folded = f"CASE WHEN {_ascii(c)} THEN {c} ELSE translate({c}, {literal(_FOLD_FROM)}, {literal(_FOLD_TO)}) END"
    # a lone space is left alone instead of being replaced by itself
    other = "[^a-z0-9 ][^a-z0-9]*| [^a-z0-9]+"
    return rf"trim(regexp_replace(regexp_replace(lower({folded}), r'[\x{{0300}}-\x{{036f}}]', ''), r'{other}', ' '))"


@normaliser("s")
def slugify(c: str) -> str:
    """Compatibility fold to ASCII, lower case, other characters become one underscore, none at the ends."""
    single = f"translate({c}, {literal('⁄' + _ASCII_FROM)}, {literal('_' + _ASCII_TO)})"
    longer = _as_map(_ASCII_LONG)
    letters = _ranges(_ASCII_LONG)
    spelled = (
        f"array_join(transform(split({single}, ''), x -> CASE WHEN x > '~' THEN coalesce(try_element_at({longer}, x), '') ELSE x END), '')"
    )
    ascii_only = rf"CASE WHEN {_ascii(c)} THEN {c} WHEN {c} RLIKE '[{letters}]' THEN {spelled} ELSE regexp_replace({single}, r'\P{{ASCII}}', '') END"
    return f"trim(BOTH '_' FROM regexp_replace(lower({ascii_only}), r'[^a-z0-9]+', '_'))"


@normaliser("s", "BIGINT")
def digits_int(c: str) -> str:
    """All digits of the text as one number, NULL without a digit."""
    return f"try_cast(nullif(regexp_replace({c}, r'[^0-9]', ''), '') AS BIGINT)"


# --- I5 to I7: addresses and names -----------------------------------------------------------------------------------


def _query_value(c: str, key: str) -> str:
    decoded = f"replace(replace({c}, '%5B', '['), '%5D', ']')"
    pattern = "[?&]" + key.replace("[", r"\[").replace("]", r"\]") + "=([^&#]*)"
    return f"nullif(regexp_extract({decoded}, r'{pattern}', 1), '')"


def _url_path(c: str) -> str:
    return f"regexp_extract({c}, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@normaliser("s")
def url_param(c: str, key: str = "country") -> str:
    """Decoded value of a query parameter."""
    return f"url_decode({_query_value(c, key)})"


@normaliser("s", "BIGINT")
def url_param_id(c: str, key: str = "id") -> str:
    """Numeric id held in a query parameter."""
    return digits_int.sql(_query_value(c, key))


@normaliser("s", "BIGINT")
def url_path_id(c: str) -> str:
    """Digits of the last path segment."""
    return digits_int.sql(f"substring_index({_url_path(c)}, '/', -1)")


@normaliser("s")
def url_slug_part(c: str, marker: str = "/coin/") -> str:
    """Path segment after a marker, up to its first hyphen; NULL without the marker."""
    return f"CASE WHEN instr({_url_path(c)}, '{marker}') > 0 THEN regexp_extract({_url_path(c)}, r'{marker}([^/-]*)', 1) END"


@normaliser("s", "BIGINT")
def folder_id(c: str) -> str:
    """Id after the last underscore of a folder name."""
    return rf"try_cast(nullif(regexp_extract({c}, r'_(\d+)$', 1), '') AS BIGINT)"


@normaliser("s")
def folder_slug(c: str) -> str:
    """Folder name without its id; the whole name when it carries none."""
    return rf"regexp_replace({c}, r'^(.*)_\d+$', '$1')"


@normaliser("s")
def file_name(c: str, strip_original: bool = False) -> str:
    """Last path segment of an address, optionally without the ``-original`` mark before the extension."""
    name = f"nullif(substring_index({_url_path(c)}, '/', -1), '')"
    return rf"regexp_replace({name}, r'-original(\.[^.]*)?$', '$1')" if strip_original else name


@normaliser("s")
def image_extension(c: str, default: str = ".jpg") -> str:
    """Whitelisted image extension of an address, with one spelling for JPEG."""
    # The accepted extensions.
    known = "'jpg', 'jpeg', 'png', 'bmp', 'tif', 'tiff', 'webp'"
    ext = rf"lower(regexp_extract({c}, r'\.([a-zA-Z0-9]{{1,5}})(?:\?|$)', 1))"
    return f"CASE WHEN {ext} IN ({known}) THEN replace(concat('.', {ext}), '.jpeg', '.jpg') ELSE '{default}' END"


# --- I8, I9: years ---------------------------------------------------------------------------------------------------

_YEAR_STRUCT = "STRUCT<year_from: INT, year_to: INT, native_from: INT, native_to: INT>"


@normaliser("s", _YEAR_STRUCT)
def parse_year_range(c: str) -> str:
    """Year or range; a closing parenthesis holds the common-era range and the rest is the native one."""
    pair, single = r"(?<!\d)(\d{3,4})\s*[–—-]\s*(\d{3,4})(?!\d)", r"(?<!\d)(\d{3,4})(?!\d)"
    tail = r"\(([^)]+)\)\s*$"

    def year(text: str, group: int) -> str:
        ranged = f"nullif(regexp_extract({text}, r'{pair}', {group}), '')"
        return f"cast(coalesce({ranged}, nullif(regexp_extract({text}, r'{single}', 1), '')) AS INT)"

    def low_high(text: str) -> tuple[str, str]:
        return f"least({year(text, 1)}, {year(text, 2)})", f"greatest({year(text, 1)}, {year(text, 2)})"

    has_tail = f"{c} RLIKE r'{tail}'"
    inner = f"regexp_extract({c}, r'{tail}', 1)"
    outer = f"regexp_replace({c}, r'{tail}', '')"
    main = low_high(f"CASE WHEN {has_tail} THEN {inner} ELSE {c} END")
    native = low_high(f"CASE WHEN {has_tail} THEN {outer} END")
    return (
        f"named_struct('year_from', {main[0]}, 'year_to', {main[1]}, 'native_from', {native[0]}, 'native_to', {native[1]})"
    )


@normaliser("s", "INT")
def start_year(c: str) -> str:
    """First number, negative before the common era, the largest int when there is none."""
    year = rf"try_cast(nullif(regexp_extract({c}, r'\d+', 0), '') AS INT)"
    return f"coalesce(CASE WHEN instr(lower({c}), 'bc') > 0 THEN -{year} ELSE {year} END, 2147483647)"


# --- I10 to I12: names -----------------------------------------------------------------------------------------------


@normaliser("s", "STRUCT<name: STRING, alt: STRING>")
def split_parenthetical(c: str) -> str:
    """``name (alt)`` into its two parts; other text is all name."""
    t, pattern = f"trim({c})", r"(?s)^(.*)\(([^)]+)\)$"
    return (
        f"CASE WHEN {t} RLIKE r'{pattern}' THEN named_struct('name', trim(regexp_extract({t}, r'{pattern}', 1)),"
        f" 'alt', trim(regexp_extract({t}, r'{pattern}', 2))) ELSE named_struct('name', {c}, 'alt', cast(NULL AS STRING)) END"
    )


@normaliser("s", "STRUCT<name: STRING, context: STRING>")
def split_context(c: str, separators: str = "›»") -> str:
    """``a › b › name`` into the last part and everything before it."""
    pattern = f"^(.*)[{separators}]([^{separators}]*)$"
    return (
        f"CASE WHEN {c} RLIKE r'[{separators}]' THEN named_struct('name', trim(regexp_extract({c}, r'{pattern}', 2)),"
        f" 'context', trim(regexp_extract({c}, r'{pattern}', 1)))"
        f" ELSE named_struct('name', {c}, 'context', cast(NULL AS STRING)) END"
    )


@normaliser("s")
def strip_wrapping(c: str) -> str:
    """Drop one surrounding pair of parentheses."""
    t = f"trim({c})"
    return rf"CASE WHEN {t} RLIKE r'(?s)^\(.*\)$' THEN trim(substr({t}, 2, length({t}) - 2)) ELSE {c} END"


# --- I16, I19 to I23, K8 ---------------------------------------------------------------------------------------------


def hard_trim(c: str) -> str:
    """Trim that also removes no-break spaces."""
    return rf"regexp_replace(regexp_replace({c}, r'^[\s\x{{00a0}}]+', ''), r'[\s\x{{00a0}}]+$', '')"


@normaliser("s")
def parse_size(c: str) -> str:
    """Size text without its trailing unit; NULL when nothing is left."""
    plain = f"trim(replace(replace({c}, '\u00a0', ' '), '&nbsp;', ' '))"
    return f"nullif(trim(regexp_replace({plain}, r'(?i)mm$', '')), '')"


@normaliser("s")
def null_if_unknown(c: str, mode: str = "any") -> str:
    """``any``: cells mentioning "unknown"; ``invite``: only those that also ask for help."""
    hit = f"instr(lower({c}), 'unknown') > 0"
    if mode == "invite":
        hit += f" AND instr(lower({c}), 'help us to know') > 0"
    return f"CASE WHEN {hit} THEN NULL ELSE {c} END"


# Known titles in priority order.
TITLES = (
    "Emperor",
    "King",
    "Regent",
    "Queen",
    "Archbishop",
    "Grand duke",
    "Empress",
    "Bishop",
    "Duke",
    "Administrator",
    "Prince-archbishop",
    "Prince",
    "Emir",
    "Count",
    "Margrave",
    "Governor",
    "Prince-bishop",
    "Sultan",
    "Shah",
    "Lord",
    "Landgrave",
    "Duchess",
    "Co-prince",
    "Ban",
    "Prince-abbot",
    "Prince elector",
    "Countess",
    "Prime minister",
    "Lady",
    "Abbess",
    "Princess",
    "Vizier",
    "Abbot",
)


def _title_forms(titles: Sequence[str]) -> list[str]:
    """Each title as written and, where that differs, with every word capitalised."""
    forms: list[str] = []
    for title in titles:
        forms.append(title)
        if not title.istitle():
            forms.append(title.title())
    return forms


@normaliser("name, heading, intro")
def rulers_title(name: str, heading: str, intro: str, titles: list[str] | None = None) -> str:
    """Title before the name in ``place: title name``; else a known title in the name; else one opening the introduction."""
    forms = _title_forms(titles or TITLES)
    listed = "array(" + ", ".join(literal(t) for t in forms) + ")"
    first_word = rf"nullif(regexp_extract({name}, r'(?U)\w+', 0), '')"
    after = f"substr({heading}, instr({heading}, ':') + 1)"
    from_heading = (
        f"CASE WHEN instr({heading}, ':') > 0 AND instr({after}, {first_word}) > 0"
        f" THEN nullif(trim(substr({after}, 1, instr({after}, {first_word}) - 1)), '') END"
    )
    from_name = f"try_element_at(filter({listed}, t -> instr({name}, concat(t, ' of')) > 0), 1)"
    from_intro = f"try_element_at(filter({listed}, t -> startswith({intro}, concat(t, ' of'))), 1)"
    return f"coalesce({from_heading}, {from_name}, {from_intro})"


def _hex(value: str, width: int) -> str:
    return f"lower(lpad(hex({value}), {width}, '0'))"


def _micros(ts: str) -> str:
    return f"unix_micros({ts}) - unix_seconds({ts}) * 1000000"


@normaliser("ts TIMESTAMP")
def ordered_hex_id(ts: str) -> str:
    """Sortable id: eight hex digits of seconds, five of microseconds."""
    instant = f"cast({ts} AS TIMESTAMP)"
    return f"concat({_hex(f'unix_seconds({instant})', 8)}, {_hex(_micros(instant), 5)})"


@normaliser("s", "STRUCT<latitude: DOUBLE, longitude: DOUBLE>")
def extract_lat_lon(c: str) -> str:
    """Coordinates from a ``map.flyTo([lat, lon]`` call; both or neither. Small numbers may have an exponent."""
    number = r"([0-9.+\-]+(?:[eE][+\-]?[0-9]+)?)"
    pattern = rf"map\.flyTo\(\s*\[\s*{number}\s*,\s*{number}\s*\]"
    lat = f"try_cast(nullif(regexp_extract({c}, r'{pattern}', 1), '') AS DOUBLE)"
    lon = f"try_cast(nullif(regexp_extract({c}, r'{pattern}', 2), '') AS DOUBLE)"
    return (
        f"named_struct('latitude', CASE WHEN {lon} IS NOT NULL THEN {lat} END,"
        f" 'longitude', CASE WHEN {lat} IS NOT NULL THEN {lon} END)"
    )


@normaliser("raw_name, raw_type, name", "ARRAY<STRING>")
def name_variants(raw_name: str, raw_type: str, name: str) -> str:
    """Names a record may be known by: ``name, type`` when typed, the raw name and the display name."""
    typed = f"CASE WHEN coalesce({raw_type}, '') <> '' THEN concat({raw_name}, ', ', {raw_type}) ELSE {raw_name} END"
    return f"array_distinct(array_compact(array({typed}, {raw_name}, {name})))"


@normaliser("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE")
def cosine(a: str, b: str) -> str:
    """Dot product of the two vectors after scaling each to length one (1e-8 guards the zero vector)."""

    def dot(x: str, y: str) -> str:
        return f"aggregate(zip_with({x}, {y}, (p, q) -> double(p) * double(q)), 0D, (acc, v) -> acc + v)"

    return f"{dot(a, b)} / ((sqrt({dot(a, a)}) + 1e-8D) * (sqrt({dot(b, b)}) + 1e-8D))"
