"""Quality rules as a decision list learned by sequential covering, applied as one Spark conditional expression.

Statistics, learning sample and verdict are DataFrame and SQL expressions; only the bounded sample of labelled statistics
comes to the driver, where thresholds are chosen.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions.arrays import let
from catalog_engine.llm.texts import sampled

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: what a rule may test
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "mark_share", "digit_share")

Condition = tuple[str, str, float]


def _covered(places: Column) -> Column:
    """Number of words in windows of three that start at the given ascending places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda seen, at: F.struct((seen["n"] + F.least(F.lit(3), at - seen["last"])).alias("n"), at.alias("last"))
    return F.aggregate(places, start, step, lambda seen: seen["n"])


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text. Windows are sorted by hash inside the row, so a
    text of n words costs n log n and nothing leaves the row."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(found: Column) -> Column:
        pairs = F.zip_with(F.slice(found, F.lit(1), F.size(found) - 1), F.slice(found, F.lit(2), F.size(found) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    return F.when(F.size(words) >= 4, let(F.sort_array(hashed), lambda found: _covered(places(found)))).otherwise(F.lit(0))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) and n_capitals,
    n_marks, n_digits, n_letters of the whole text; a null text counts as empty. Columns of these names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    out = docs.withColumns({
        "_counts": counts,
        "n_symbols": without(SYMBOLS).cast("long"),
        "n_dup_lines": let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long"),
        "n_capitals": without("[A-Z]").cast("long"),
        "n_marks": without("[!?;:=~^_@/]").cast("long"),
        "n_digits": without("[0-9]").cast("long"),
    })
    return out.withColumns({c: F.col(f"_counts.{c}").cast("long") for c in ("n_words", "word_chars", "n_repeat_words")}).drop("_counts")


def features() -> dict[str, Column]:
    """The shares that rules test, from the counts."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "capital_share": F.col("n_capitals") / chars,
        "mark_share": F.col("n_marks") / chars,
        "digit_share": F.col("n_digits") / chars,
    }


def holds(row: dict, rule: list[Condition]) -> bool:
    return all(row[name] <= limit if sign == "<=" else row[name] > limit for name, sign, limit in rule)


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information that a condition adds about the rows that should be covered."""
    return bad * (log2(bad / (bad + good)) - log2(bad_before / (bad_before + good_before))) if bad else -1.0


def _best_condition(rows: list[dict]) -> tuple[float, Condition] | None:
    bad_all = sum(r["bad"] for r in rows)
    best = None
    for name in FEATURES:
        ordered = sorted((r[name], r["bad"]) for r in rows)
        seen_bad = 0
        for k in range(len(ordered) - 1):
            seen_bad += ordered[k][1]
            if ordered[k][0] == ordered[k + 1][0]:
                continue
            limit = (ordered[k][0] + ordered[k + 1][0]) / 2
            for sign, bad, size in (("<=", seen_bad, k + 1), (">", bad_all - seen_bad, len(rows) - k - 1)):
                gain = _gain(bad, size - bad, bad_all, len(rows) - bad_all)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, (name, sign, limit))
    return best


def learn_rules(rows: list[dict], most_rules: int = 12, most_conditions: int = 4, least_covered: int = 5, least_precision: float = 0.9) -> list[tuple[list[Condition], float]]:
    """Ordered rules (conditions, precision) that recognise the rows marked bad.

    Two thirds of the rows grow a rule, condition by condition, while it still covers good rows; the others prune it from its
    end while that does not lower (bad - good) / (bad + good) there. A rule whose precision, with Laplace's correction,
    is under ``least_precision``, or that covers too few bad rows, ends the list.
    """
    left, found = list(rows), []
    while len(found) < most_rules:
        grow, prune = [r for k, r in enumerate(left) if k % 3], [r for k, r in enumerate(left) if k % 3 == 0]
        if sum(r["bad"] for r in grow) < least_covered:
            break
        rule, covered = [], grow
        while len(rule) < most_conditions and any(not r["bad"] for r in covered) and any(r["bad"] for r in covered):
            best = _best_condition(covered)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            covered = [r for r in covered if holds(r, [best[1]])]

        def worth(conditions: list[Condition], held_back: list[dict] = prune) -> float:
            hit = [r["bad"] for r in held_back if holds(r, conditions)]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = [r["bad"] for r in left if rule and holds(r, rule)]
        precision = (sum(hit) + 1) / (len(hit) + 2)
        if not rule or sum(hit) < least_covered or precision < least_precision:
            break
        found.append((rule, precision))
        left = [r for r in left if not holds(r, rule)]
    return found


def fit_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = 5000) -> list[tuple[list[Condition], float]]:
    """Learns from the statistics of about ``rows`` labelled documents, taken by a hash of the key. Several labels of a key
    count by their mean, several texts by one of them. No labels give no rules."""
    marked = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).filter(F.col("_key").isNotNull() & F.col("_label").isNotNull())
    marked = marked.groupBy("_key").agg((F.avg("_label") < 0.5).cast("int").alias("bad"))
    total = marked.count()
    # bounded by ``rows``
    chosen = F.broadcast(sampled(marked, "_key", rows / total if total else 1.0))
    known = with_statistics(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key"), "_text")
    # one row per key, so that rows that repeat a key don't lengthen the sample
    one = known.select("_key", "bad", F.struct(*[c.alias(n) for n, c in features().items()]).alias("_one")).groupBy("_key", "bad").agg(F.min("_one").alias("_one"))
    sample = [r.asDict() for r in one.select("_key", "bad", "_one.*").collect()]
    sample.sort(key=lambda r: (r["_key"], r["n_words"], r["mean_word"]))
    return learn_rules(sample)


def rejects(rules: list[tuple[list[Condition], float]]) -> Column:
    """Number of the first rule that fires, from 1; 0 if none does."""
    column, known = F.lit(0), features()
    for number, (rule, _) in reversed(list(enumerate(rules, 1))):
        tests = [known[n] <= limit if sign == "<=" else known[n] > limit for n, sign, limit in rule]
        fires = tests[0]
        for test in tests[1:]:
            fires = fires & test
        column = F.when(fires, F.lit(number)).otherwise(column)
    return column


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[tuple[list[Condition], float]], text: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed, rule (number of the rule that fired, 0 for none) and kept."""
    return with_statistics(docs, text).withColumns({"base_failed": base_failed(), "rule": rejects(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
