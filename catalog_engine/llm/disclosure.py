"""Personal data in texts, and the terms that give it away.

Patterns find what is personal by its form (e-mail and network addresses, card and phone numbers). Each distinct value is an
entity to protect. A term that stands near it can disclose it too: its pointwise mutual information with the entity, taken from
all texts of the corpus, tells how many of the bits that the entity is worth are known once the term is. Terms that give away a
share of ``GENERALISE`` are generalised wherever they stand, and those over ``REMOVE`` are removed.

Only DataFrame functions are used: matches are cut out by regular expressions, their places are running sums of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions.arrays import let
from catalog_engine.workspace import staged

KINDS = ("email", "ip", "card", "phone")
_NAME = "[A-Za-z0-9._%+-]"
# Possessive repeats and the look-behinds keep the work linear and change no match: a name begins where its run of characters
# does or where the last match ended, and what follows a repeat is never one of its own characters. Cards need 16 digits, so
# shorter runs need no match.
PATTERNS = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: texts without this character need no search
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: share of an entity's bits that a term may disclose before it is generalised, and before it is removed
GENERALISE, REMOVE = 0.7, 0.9
#: in so many different surroundings a term must stand near an entity, and so many words on each side are near
CONTEXTS, NEAR_WORDS, NEAR_CHARS = 3, 6, 160
#: up to so many disclosing terms go to every task, which looks them up inside the row; more are joined
TERMS_IN_ROW = 5_000

SPAN = "struct<start:bigint,stop:bigint,value:string>"
_APART = r"[^\p{L}\p{N}]+"


def running_totals(numbers: Column, block: int = 256) -> Column:
    """For each number the sum of those before it; by blocks, so that many numbers cost little more than few."""
    zero = F.lit(0).cast("bigint")
    add = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    before = lambda xs, start: F.slice(F.aggregate(xs, F.array(start), add), 1, F.size(xs))

    def totals(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
        return let(before(sums, zero), lambda starts: F.flatten(F.transform(blocks, lambda b, k: before(b, F.get(starts, k)))))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda k: F.slice(xs, k * block + 1, block))
    return let(numbers, lambda xs: F.when(F.size(xs) > 0, let(cut(xs), totals)).otherwise(F.array().cast("array<bigint>")))


def located(text: Column, pattern: Column, sign: str = "") -> Column:
    """Matches of the pattern as (start, stop, value), in code points; none in a text without ``sign``."""

    def spans(parts: Column) -> Column:
        gaps = F.transform(parts["gaps"], lambda g: F.length(g).cast("bigint"))
        widths = F.transform(parts["hits"], lambda h, i: F.length(F.get(parts["gaps"], i)) + F.length(h).cast("bigint"))
        placed = F.struct(gaps.alias("gaps"), running_totals(widths).alias("before"))

        def span(at: Column, hit: Column, i: Column) -> Column:
            start = F.get(at["before"], i) + F.get(at["gaps"], i)
            return F.struct(start.alias("start"), (start + F.length(hit)).alias("stop"), hit.alias("value"))

        return let(placed, lambda at: F.transform(parts["hits"], lambda h, i: span(at, h, i)))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return F.when(F.contains(text, F.lit(sign)) & F.regexp_like(text, pattern), let(both, spans)).otherwise(F.array()).cast(f"array<{SPAN}>")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    def weight(back: Column, i: Column) -> Column:
        digit = back.substr(i, F.lit(1)).cast("int")
        twice = digit * (F.when(i % 2 == 0, 2).otherwise(1))
        return twice - F.when(twice > 9, 9).otherwise(0)

    total = lambda back: F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + weight(back, i))
    return let(F.reverse(number), total) % 10 == 0


def is_personal(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & passes_luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def personal_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of its (start, stop, value): leftmost matches that do not overlap; wrong ones are left out."""

    def spans(kind: str) -> Column:
        return F.filter(located(text, F.lit(PATTERNS[kind]), SIGNS[kind]), lambda s: is_personal(kind, s["value"]))

    return {kind: spans(kind) for kind in KINDS}


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case, without those of words with an ``@``."""
    low = F.lower(text)
    plain = F.when(F.contains(low, F.lit("@")), F.regexp_replace(low, r"(?<!\S)[^\s@]*+@\S*+", " ")).otherwise(low)
    return F.split(plain, _APART)


def terms_of(text: Column) -> Column:
    """The words that can be terms: at least three characters, one of them a letter."""
    return F.filter(words_of(text), lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}"))


def _entities(kind: str) -> Column:
    """The spans of a kind with their value in one form."""
    form = {"email": F.lower, "ip": lambda v: v}.get(kind, digits)
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.concat(F.lit(f"{kind}:"), form(s["value"])).alias("entity")))


def mentions(docs: DataFrame) -> DataFrame:
    """(text_hash, said) of the rows that mention an entity; ``said`` has the entity and the terms around it of each mention."""
    found = docs.select("text", *[spans.alias(kind) for kind, spans in personal_spans(F.col("text")).items()])
    each = found.withColumn("at", F.concat(*[_entities(k) for k in KINDS])).filter(F.size("at") > 0)
    text = F.col("text")

    def before(at: Column) -> Column:
        begin = F.greatest(at["start"] - NEAR_CHARS, F.lit(0)).cast("int")
        left = text.substr(begin + 1, (at["start"] - begin).cast("int"))
        # a word that the cut may have shortened is none
        whole = lambda part: terms_of(F.when(begin > 0, F.regexp_replace(part, r"^[\p{L}\p{N}]+", "")).otherwise(part))
        return let(let(left, whole), lambda w: F.slice(w, F.greatest(F.size(w) - NEAR_WORDS + 1, F.lit(1)), NEAR_WORDS))

    def behind(at: Column) -> Column:
        right = text.substr((at["stop"] + 1).cast("int"), F.lit(NEAR_CHARS))
        whole = lambda part: terms_of(F.when(F.length(part) == NEAR_CHARS, F.regexp_replace(part, r"[\p{L}\p{N}]+$", "")).otherwise(part))
        return F.slice(let(right, whole), 1, NEAR_WORDS)

    said = F.transform("at", lambda at: F.struct(at["entity"].alias("entity"), F.concat(before(at), behind(at)).alias("near")))
    return each.select(F.xxhash64("text").alias("text_hash"), said.alias("said"))


def disclosing_terms(docs: DataFrame, contexts: int = CONTEXTS, share: float = GENERALISE) -> DataFrame | None:
    """(term, share) of the terms that disclose an entity, from the column ``text`` of all documents; None without any.

    With n documents, of which c hold the entity, t the term and j both near each other, the term discloses
    log(j n / (c t)) of the log(n / c) bits; an entity that all documents hold has none to disclose. What is copied is no
    evidence: the term must stand near the entity in ``contexts`` different surroundings and texts.
    """
    met = staged(mentions(docs), "mentions")
    pairs = F.flatten(F.transform("said", lambda s: F.transform(s["near"], lambda w: F.struct(s["entity"].alias("entity"), w.alias("term")))))
    joint = met.select(F.inline(F.array_distinct(pairs))).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("joint"))
    around = met.select("text_hash", F.inline("said")).select("entity", "text_hash", F.xxhash64("near").alias("around"), F.explode(F.array_distinct("near")).alias("term"))

    def several(what: str) -> DataFrame:
        different = around.select("entity", "term", what).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n"))
        return different.filter(F.col("n") >= contexts).select("entity", "term")

    supported = several("text_hash").join(several("around"), ["entity", "term"], "left_semi")
    candidates = staged(joint.join(supported, ["entity", "term"], "left_semi"), "candidates")
    if candidates.isEmpty():
        return None
    of_entity = met.select(F.explode(F.array_distinct("said.entity")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("holding"))
    # counted before the join, so that each task hands on a word once and the join sees words, not the texts they are in
    held = docs.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    of_term = held.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    n = F.lit(float(docs.count()))
    known = F.log(F.col("joint") * n / (F.col("holding") * F.col("seen"))) / F.nullif(F.log(n / F.col("holding")), F.lit(0.0))
    scored = candidates.join(of_entity, "entity").join(of_term, "term").select("term", known.alias("share"))
    terms = staged(scored.groupBy("term").agg(F.max("share").alias("share")).filter(F.col("share") >= share), "terms")
    return None if terms.isEmpty() else terms


LEAKS = "array<struct<term:string,share:double>>"


def leaks_inside(whole: DataFrame, terms: DataFrame, count: int) -> DataFrame:
    """``whole`` with the terms that the row's ``text`` holds, from ``count`` slots by hash that go to the tasks as one value."""
    slot = lambda word: F.pmod(F.xxhash64(word), F.lit(count)).cast("int")
    filled = terms.groupBy(slot(F.col("term")).alias("slot")).agg(F.collect_list(F.struct("term", "share")).alias("own"))
    every = terms.sparkSession.range(count).join(filled, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("own", F.array().cast(LEAKS)).alias("own"))
    slots = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "own"))), lambda s: s["own"]).alias("slots")).scalar()
    own = lambda held, word: F.filter(F.get(held, slot(word)), lambda s: s["term"] == word)
    # each is mentioned once behind, so the value is not copied into the rows
    ready = whole.withColumns({"words": F.array_distinct(words_of(F.col("text"))), "slots": slots})
    leaks = let(F.col("slots"), lambda held: F.array_sort(F.flatten(F.transform("words", lambda w: own(held, w)))))
    return ready.withColumn("leaks", leaks).drop("words", "slots")


def with_leaks(whole: DataFrame, terms: DataFrame | None, in_row: int = TERMS_IN_ROW) -> DataFrame:
    """``whole`` (row, text, digest) with ``leaks``: the disclosing terms of the text and their shares."""
    count = 0 if terms is None else terms.count()
    if not count:
        return whole.withColumn("leaks", F.lit(None).cast(LEAKS))
    if count <= in_row:
        return leaks_inside(whole, terms, count)
    held = whole.select("digest", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).join(terms, "term").distinct()
    leaks = staged(held.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("term", "share"))).alias("leaks")), "leaks")
    return whole.join(leaks, "digest", "left")


def find_personal(docs: DataFrame, text: str = "text", keep: list[str] | None = None, contexts: int = CONTEXTS, share: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Columns ``keep``, arrays ``email``, ``ip``, ``card``, ``phone`` of (start, stop, value), ``term`` of (start, stop,
    value, label) for the terms that disclose a value somewhere in the corpus, and ``sanitised``: the text with all of that
    generalised to a label in brackets, or removed.

    Places count code points. A null text is the empty text, which holds nothing; every row counts in the statistics,
    and equal texts have equal results; an empty table gives an empty one. Other columns are not looked at. The
    terms are looked up inside the row, so no text is shuffled; only if there are more than ``TERMS_IN_ROW`` of them do rows
    meet the terms of their text by the digest of the whole text.
    """
    keep = keep or ["doc_id"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), body.alias("text"), F.sha2(body, 256).alias("digest"))
    terms = disclosing_terms(whole.select("text"), contexts, share)
    joined = with_leaks(whole, terms)
    spans = personal_spans(F.col("text"))
    found = joined.select("row", "text", "leaks", *[spans[k].alias(k) for k in KINDS])
    return found.withColumn("term", _term_spans(remove)).select("row.*", *KINDS, "term", _sanitised().alias("sanitised"))


def _term_spans(remove: float) -> Column:
    """Places of the terms that a row's text discloses something by, outside of what the patterns found."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("leaks.term", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    base = F.concat(*KINDS)

    def labelled(shares: Column) -> Column:
        shape = lambda v: F.when(v.rlike(r"\p{N}"), "[code]").when(v.rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")
        label = lambda v: F.when(F.coalesce(F.try_element_at(shares, F.lower(v)), F.lit(0.0)) >= remove, "").otherwise(shape(v))
        return F.transform(located(F.col("text"), pattern), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), label(s["value"]).alias("label")))

    places = let(F.map_from_entries("leaks"), labelled)
    free = F.filter(places, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint,value:string,label:string>>")
    return F.when(F.size("leaks") > 0, free).otherwise(nothing)


def _sanitised() -> Column:
    def labels(kind: str) -> Column:
        label = (lambda s: s["label"]) if kind == "term" else lambda s: F.lit(f"[{kind}]")
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), label(s).alias("label")))

    spans = F.array_sort(F.concat(*[labels(k) for k in (*KINDS, "term")]))
    text = F.col("text")

    def step(done: Column, s: Column) -> Column:
        gap = text.substr((done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        out = F.when(s["start"] >= done["at"], F.concat(done["out"], gap, s["label"])).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), out.alias("out"))

    rest = lambda done: F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), F.length(text)))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(text)


def span_list(kind: str, spans: str) -> Column:
    """``kind:start:stop`` of each span, by start."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))
