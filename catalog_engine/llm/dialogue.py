"""Repair of conversations: the cheapest edits after which the roles follow ``(s?(ua)+)?``.

Every row becomes a symbol of its role's initial and its first fault. A conversation's cost is a product of min-plus matrices
over four states (nothing yet, system, user, assistant), one matrix a symbol: runs of equal symbols are collapsed, and a run of
n rows is advanced through the cached powers 1, 2, 4, ... of its matrix. From the costs behind each run the edits are unrolled
forwards, always taking the least letter among the cheapest.

Conversations are cut into blocks of ``BLOCK_ROWS`` rows. Blocks of one conversation need only each other's matrices (16
numbers) and, in the second pass, each other's final state, so a conversation of any length is judged by many tasks. Rows
travel without their texts until the edits are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.operators.numbering import spread_row_number
from catalog_engine.workspace import staged

BLOCK_ROWS = 512
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

Costs = tuple[int, int, int, int]
#: no way from one state to another; sums of it stay far below 2 ** 63
NEVER = 1 << 50
#: state after the next user or assistant turn, and the letter of that turn
NEXT, LETTER = (2, 2, 3, 2), "uuau"
#: costs of ending a conversation in each state, and the inserted turns that it takes
FINAL: Costs = (0, 2 * INSERT, INSERT, 0)
ENDING = ("", "UA", "A", "")
#: how edits are written down: delete, keep, rerole to user or assistant, insert user or assistant
CODES, INITIALS = "DKuaUA", "DKRRII"
PRICE = {"D": DELETE, "K": 0, "u": REROLE, "a": REROLE, "U": INSERT, "A": INSERT}


def after_keeping(symbol: str, state: int) -> int | None:
    """The state after a row that keeps its role; None if it cannot stand here."""
    letter = symbol.lower()
    if letter == "s":
        return 1 if state == 0 else None
    return NEXT[state] if letter == LETTER[state] else None


def edits_of(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(code, cost, next state) of the ways to deal with a row, in the order of their initials; ``d`` must go."""
    yield "D", DELETE, state
    if symbol != "d":
        fault = TRUNCATED if symbol.isupper() else 0
        kept = after_keeping(symbol, state)
        if kept is not None:
            yield "K", fault, kept
        yield LETTER[state], REROLE + fault, NEXT[state]


class Transitions:
    """Matrices and choices of all symbols, computed when first met."""

    def __init__(self):
        self.powers: dict[tuple[str, int], tuple[Costs, ...]] = {}
        self.choices: dict[tuple[str, int, Costs], tuple[str, int]] = {}

    def one(self, symbol: str) -> tuple[Costs, ...]:
        rows = []
        for state in range(4):
            row, here = [NEVER] * 4, state
            for inserted in range(3):
                for _, cost, target in edits_of(symbol, here):
                    row[target] = min(row[target], inserted * INSERT + cost)
                here = NEXT[here]
            rows.append(tuple(row))
        return tuple(rows)

    def power(self, symbol: str, k: int) -> tuple[Costs, ...]:
        """The matrix of 2^k rows with this symbol."""
        if (symbol, k) not in self.powers:
            half = self.power(symbol, k - 1) if k else None
            self.powers[symbol, k] = product(half, half) if half else self.one(symbol)
        return self.powers[symbol, k]

    def before(self, symbol: str, count: int, costs: Costs) -> Costs:
        """Costs before so many rows with this symbol, from the costs behind them."""
        k = 0
        while count:
            if count & 1:
                costs = applied(self.power(symbol, k), costs)
            count, k = count >> 1, k + 1
        return costs

    def choose(self, symbol: str, state: int, costs: Costs) -> tuple[str, int]:
        """Codes of the inserted turns and of the edit of the next row, and the state behind it."""
        least = min(costs)
        key = (symbol, state, tuple(c - least for c in costs))
        if key not in self.choices:
            codes, here, left = "", state, self.before(symbol, 1, costs)
            while True:
                ways = {code: target for code, cost, target in edits_of(symbol, here) if cost + costs[target] == left[here]}
                if "D" not in ways and INSERT + left[NEXT[here]] == left[here]:
                    codes, here = codes + LETTER[here].upper(), NEXT[here]
                    continue
                code = next(iter(ways))
                self.choices[key] = codes + code, ways[code]
                break
        return self.choices[key]


def product(a: tuple[Costs, ...], b: tuple[Costs, ...]) -> tuple[Costs, ...]:
    return tuple(tuple(min(NEVER, *(row[m] + b[m][t] for m in range(4))) for t in range(4)) for row in a)


def applied(matrix: tuple[Costs, ...], costs: Costs) -> Costs:
    return tuple(min(row[t] + costs[t] for t in range(4)) for row in matrix)


Run = tuple[str, int, list[int]]


def collapsed(symbols: str, copies: list[int]) -> list[Run]:
    """Runs of equal symbols: (symbol, rows, number of rows of each part). A copy of a row must go, so it is a ``d``."""
    parts = [(s, [n]) if s == "d" else (s, [1, n - 1]) for s, n in zip(symbols, copies)]
    flat = [(symbol if k == 0 else "d", size) for symbol, sizes in parts for k, size in enumerate(sizes) if size]
    runs = []
    for symbol, equal in groupby(flat, key=lambda part: part[0]):
        sizes = [size for _, size in equal]
        runs.append((symbol, sum(sizes), sizes))
    return runs


def matrix_of(runs: list[Run], moves: Transitions) -> list[int]:
    """The product of all runs, row by row."""
    columns = []
    for target in range(4):
        costs: Costs = tuple(0 if t == target else NEVER for t in range(4))
        for symbol, count, _ in reversed(runs):
            costs = moves.before(symbol, count, costs)
        columns.append(costs)
    return [min(NEVER, columns[t][s]) for s in range(4) for t in range(4)]


def unrolled(runs: list[Run], ahead: Costs, state: int, moves: Transitions) -> tuple[list[tuple[int, str]], int]:
    """(rows, codes) of the parts of all runs in order, and the state at the end."""
    behind = [ahead]
    for symbol, count, _ in reversed(runs):
        behind.append(moves.before(symbol, count, behind[-1]))
    out = []
    for (symbol, count, sizes), costs in zip(runs, reversed(behind[:-1])):
        if symbol == "d":
            out += [(size, "D" * size) for size in sizes]
            continue
        inside = [costs]
        while len(inside) < count:
            inside.append(moves.before(symbol, 1, inside[-1]))
        for costs_behind in reversed(inside):
            codes, state = moves.choose(symbol, state, costs_behind)
            out.append((1, codes))
    return out, state


def codes_of_items(symbols: str, copies: list[int], ahead: Costs, state: int, moves: Transitions) -> tuple[list[str], int]:
    """The codes of each item (a row and its copies) and the state at the end."""
    parts, end = unrolled(collapsed(symbols, copies), ahead, state, moves)
    waiting, codes = iter(parts), []
    for count in copies:
        item = ""
        while count:
            size, more = next(waiting)
            item, count = item + more, count - size
        codes.append(item)
    return codes, end


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def items(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: (conv, turn, role, digest, symbol, copies).

    Keys are structs with one field, which are equal and come first when that field is null."""
    cut = ~F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")
    same = rows.select("conv", "turn", "role", "digest", blank(F.col("text")).alias("blank"), cut.alias("cut")).groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("copies"))
    same = staged(same, "items")
    first = same.filter("NOT blank").groupBy("conv", "role", "digest").agg(F.min("turn").alias("first"))
    letter = F.left("role", F.lit(1))
    letter = F.when(letter.isin("s", "u", "a"), letter).otherwise("x")
    symbol = F.when(F.col("blank") | (F.col("turn") != F.col("first")), "d").when(F.col("cut"), F.upper(letter)).otherwise(letter)
    return same.join(first, ["conv", "role", "digest"], "left").select("conv", "turn", "role", "digest", "blank", symbol.alias("symbol"), "copies")


def with_edits(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The items with ``place`` (from 1, in order) and ``codes``, the edits of the row and its copies and what is inserted
    before or, at the end, behind them."""
    numbered = staged(spread_row_number(items(rows), ["conv"], [F.col(c) for c in ("turn", "role", "digest")], "place"), "numbered")
    block = ((F.col("place") - 1 - (F.col("place") - 1) % block_rows) / block_rows).cast("long")
    gathered = numbered.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "symbol", "copies"))).alias("held"))
    blocks = staged(gathered.select("conv", "block", F.array_join("held.symbol", "").alias("symbols"), F.col("held.copies").alias("copies")), "blocks")
    several = staged(blocks.filter("block > 0").select("conv").distinct(), "several")
    conv = blocks.schema["conv"]
    numbers = T.ArrayType(T.LongType())

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Transitions()
        for batch in batches:
            made = [matrix_of(collapsed(s, c), moves) for s, c in zip(batch.column("symbols").to_pylist(), batch.column("copies").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(made, pa.list_(pa.int64()))], names=["conv", "block", "matrix"])

    def backwards(chain: pa.Table) -> pa.Table:
        chain = chain.sort_by("block")
        costs, ahead = FINAL, []
        for flat in reversed(chain.column("matrix").to_pylist()):
            ahead.append(costs)
            costs = applied(tuple(tuple(flat[4 * s : 4 * s + 4]) for s in range(4)), costs)
        last = [False] * (len(ahead) - 1) + [True]
        return pa.table({"conv": chain.column("conv"), "block": chain.column("block"), "ahead": pa.array(ahead[::-1], pa.list_(pa.int64())), "last": last})

    def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Transitions()
        for batch in batches:
            every, ends = [], []
            for number, symbols, copies, ahead, last in zip(*(batch.column(c).to_pylist() for c in ("block", "symbols", "copies", "ahead", "last"))):
                ways = [codes_of_items(symbols, copies, tuple(ahead), state, moves) for state in range(4 if number else 1)]
                if last:
                    ways = [([*codes[:-1], codes[-1] + ENDING[end]], end) for codes, end in ways]
                every.append([codes for codes, _ in ways])
                ends.append([end for _, end in ways])
            columns = [batch.column("conv"), batch.column("block"), pa.array(every, pa.list_(pa.list_(pa.string()))), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "block", "ways", "ends"])

    def forwards(chain: pa.Table) -> pa.Table:
        chain = chain.sort_by("block")
        state, entered = 0, []
        for ends in chain.column("ends").to_pylist():
            entered.append(state)
            state = ends[state]
        return pa.table({"conv": chain.column("conv"), "block": chain.column("block"), "entered": pa.array(entered, pa.int64())})

    keys = [conv, blocks.schema["block"]]
    linked = blocks.join(several, "conv", "left_semi").mapInArrow(matrices, T.StructType([*keys, T.StructField("matrix", numbers)]))
    ahead = linked.groupBy("conv").applyInArrow(backwards, T.StructType([*keys, T.StructField("ahead", numbers), T.StructField("last", T.BooleanType())]))
    known = blocks.join(ahead, ["conv", "block"], "left").withColumn("last", F.coalesce("last", F.lit(True)))
    known = known.withColumn("ahead", F.coalesce("ahead", F.array(*[F.lit(c).cast("long") for c in FINAL])))
    chosen = staged(known.mapInArrow(choices, T.StructType([*keys, T.StructField("ways", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("ends", numbers)])), "choices")
    entered = chosen.join(several, "conv", "left_semi").select("conv", "block", "ends").groupBy("conv").applyInArrow(forwards, T.StructType([*keys, T.StructField("entered", T.LongType())]))
    final = chosen.join(entered, ["conv", "block"], "left").select("conv", "block", F.get("ways", F.coalesce("entered", F.lit(0)).cast("int")).alias("codes"))
    coded = final.select("conv", (F.col("block") * block_rows).alias("skipped"), F.posexplode("codes").alias("at", "codes"))
    return numbered.join(coded.select("conv", (F.col("skipped") + F.col("at") + 1).alias("place"), "codes"), ["conv", "place"])


def keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    shown = [F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))]
    named = rows.select(F.struct(F.col(f"`{conv}`").alias("id")).alias("conv"), F.struct(F.col(f"`{turn}`").alias("n")).alias("turn"), *shown)
    return named.withColumn("digest", F.sha2("text", 256))


REPORT = [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
    T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")
]


class Report:
    """Counts of one conversation, taken from its items in order, and the digest of its repaired lines."""

    def __init__(self, conv):
        self.conv, self.first, self.last, self.turns, self.letter, self.lines = conv, None, None, 0, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.edits: list[str] = []
        self.digest = hashlib.sha256()

    def item(self, turn: int | None, role: str, empty: bool, symbol: str, copies: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.blank += copies if empty else 0
        self.duplicate += 0 if empty else copies - (symbol != "d")
        self.truncated += symbol.isupper()
        letter = role[:1]
        self.illegal += copies - 1 + (self.letter is not None and self.letter + letter not in ("su", "ua", "au"))
        self.letter = letter

    def row(self, codes: str, role: str, text: str | None) -> None:
        self.edits.append(codes)
        for code in codes.replace("D", ""):
            line = {"K": f"{role}:{text}", "u": f"user:{text}", "a": f"assistant:{text}", "U": "user:", "A": "assistant:"}[code]
            self.digest.update(("\n" if self.lines else "").encode() + line.encode())
            self.lines += 1

    def cells(self) -> tuple:
        codes = "".join(self.edits)
        audit = codes.translate(str.maketrans(CODES, INITIALS))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, audit, self.digest.hexdigest()


def repair(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conversation: what is wrong with it and the cheapest edits, (conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256).

    Rows come in the order of their turn (nulls first), then of role and of the text's digest. A null role or text is one
    space. Rows with the null key are one conversation. Conversations of ``conversations`` (by the column ``conv``) without a
    row have zeros, an empty audit and the digest of the empty text; an empty table gives an empty one. Equal rows are one
    item with a number of copies, so many copies cost one item. Other columns of ``rows`` are not looked at.

    In the last step the texts of a conversation pass through one task, in order and one after the other, because the digest
    covers all of them; what is held is the audit alone.
    """
    given = keyed(rows, conv, turn, role, text)
    edited = with_edits(given, block_rows)
    blanks = {"role": "string", "digest": "string", "text": "string", "symbol": "string", "codes": "string", "blank": "boolean", "copies": "long"}
    none = lambda *names: [F.lit(None).cast(blanks[c]).alias(c) for c in names]
    no_turn = F.lit(None).cast(given.schema["turn"].dataType).alias("turn")
    wanted = given.select("conv") if conversations is None else conversations.select(F.struct(F.col(f"`{conv}`").alias("id")).alias("conv"))
    heads = wanted.distinct().select("conv", no_turn, *none("role", "digest"), F.lit(0).alias("kind"), *none("blank", "symbol", "copies", "codes", "text"))
    middle = edited.select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), "blank", "symbol", "copies", "codes", *none("text"))
    texts = given.filter(~blank(F.col("text"))).select("conv", "turn", "role", "digest", F.lit(2).alias("kind"), *none("blank", "symbol", "copies", "codes"), "text")
    order = [F.col("conv.id"), F.when(F.col("kind") == 0, 0).otherwise(1), F.col("turn.n"), F.col("role"), F.col("digest"), F.col("kind")]
    places = [f"order{k}" for k in range(len(order))]
    together = heads.unionByName(middle).unionByName(texts).select("*", *[c.alias(p) for c, p in zip(order, places)])
    lined = together.repartition(F.col("conv")).sortWithinPartitions(*places).drop(*places)
    schema = T.StructType([given.schema["conv"].dataType["id"], *REPORT])
    names = ["id", *[f.name for f in REPORT]]
    read = ("role", "kind", "blank", "symbol", "copies", "codes", "text", "digest")

    def told(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [[r.conv for r, _ in done]] + [[c[k] for _, c in done] for k in range(len(REPORT))]
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def finished(report: Report, cost: int) -> tuple[Report, tuple]:
        *counts, audit, digest = report.cells()
        return report, (*counts, cost, audit, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, cost, item, kind, done = None, 0, None, None, []
        for batch in batches:
            ids = pa.compute.struct_field(batch.column("conv"), [0])
            turns = pa.compute.struct_field(batch.column("turn"), [0]).to_pylist()
            kind = ids.type
            columns = [batch.column(c).to_pylist() for c in read]
            for conv_id, n, (role, what, empty, symbol, copies, codes, text, digest) in zip(ids.to_pylist(), turns, zip(*columns)):
                if what == 0 or report is None or report.conv != conv_id:
                    if report is not None:
                        done.append(finished(report, cost))
                    report, cost, item = Report(conv_id), 0, None
                if what == 1:
                    report.item(n, role, empty, symbol, copies)
                    cost += sum(map(PRICE.get, codes)) + (TRUNCATED if symbol.isupper() and codes.strip("UA")[:1] != "D" else 0)
                    item = (n, role, digest, codes)
                    if not codes.strip("DUA"):
                        report.row(codes, role, None)
                        item = None
                elif what == 2 and item is not None and item[:3] == (n, role, digest):
                    report.row(item[3], role, text)
                    item = None
                if len(done) >= 10_000:
                    yield told(done, kind)
                    done = []
        if report is not None:
            done.append(finished(report, cost))
        if done:
            yield told(done, kind)

    return lined.mapInArrow(run, schema).withColumnRenamed("id", conv)


def repaired_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations as rows (conv, place, role, text), in the order of ``place`` within a conversation.

    Nulls, ties and repeated rows are as in ``repair``. No conversation passes through one task."""
    given = keyed(rows, conv, turn, role, text)
    edited = with_edits(given, block_rows).filter(F.col("codes").rlike("[^D]"))
    texts = given.groupBy("conv", "turn", "role", "digest").agg(F.first("text").alias("text"))
    lines = edited.join(texts, ["conv", "turn", "role", "digest"]).select("conv", "place", "role", "text", F.posexplode(F.split("codes", "")).alias("at", "code"))
    new_role = F.when(F.lower("code") == "u", "user").when(F.lower("code") == "a", "assistant").otherwise(F.col("role"))
    inserted = F.col("code").isin("U", "A")
    kept = lines.filter("code IN ('K', 'u', 'a', 'U', 'A')")
    return kept.select(F.col("conv.id").alias(conv), F.struct("place", "at").alias("place"), new_role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))
