"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and pairs of user
and assistant turns.

Rows of one conversation stand by turn (null first), then role and text; equal rows side by side. Each row's first fault
counts: blank, a repeat of an earlier row's role and text, or cut off before a full stop, exclamation or question mark.
Keeping a row costs 0, another role 2, deletion 3 (blank and repeated rows have to go), an added empty turn 2, and an
undeleted cut-off row 1 more. Of equally cheap edits, those whose initials (D, I, K, R) come first in ASCII are made.

A row's symbol is its role's initial and its fault. Equal neighbours make up a run, and a run's effect on the least costs
of the four states (nothing yet, after system, after user, after assistant) is a power of its symbol's min-plus matrix.
Costs go backwards over runs by cached powers of two; choices are unrolled by halving runs with the same powers.

Null role and text count as one space. A null conv_id is a conversation like others. Rows equal in all columns count
each. A conversation without rows is not in the result of repair(). Other columns take no part. One conversation's
symbols, not its texts, meet in one task, as its audit is one value; texts are sorted by Spark and hashed as they pass.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FINAL = (START, ASSISTANT)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 0, 2, 3, 2, 1
#: Where a system, user or assistant turn may follow, and the state after it.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: State after the turn that is added, or that a turn of any role becomes.
ADDED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: Faults as a row's symbol has them.
SOUND, CUT, GONE = range(3)
NEVER = 1 << 60

Matrix = tuple[tuple[int, ...], ...]


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def _times(a: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(NEVER, *(x + y for x, y in zip(row, costs))) for row in a)


def _inserts() -> Matrix:
    one = tuple(tuple(0 if i == j else INSERT_COST if ADDED[i] == j else NEVER for j in range(4)) for i in range(4))
    return _product(one, one)  # a third would come back to where it began


INSERTS = _inserts()
END = _times(INSERTS, tuple(0 if q in FINAL else NEVER for q in range(4)))


@functools.cache
def _options(symbol: str) -> dict[int, list[tuple[str, int, int]]]:
    """By state: (edit, cost, state after) of a row, apart from what is added before it."""
    initial, fault = symbol[:-1], int(symbol[-1])
    more = CUT_COST if fault == CUT else 0
    out = {q: [("D", DELETE_COST, q)] for q in range(4)}
    if fault != GONE:
        for q, to in AFTER.get(initial, {}).items():
            out[q].append(("K", KEEP_COST + more, to))
        for q, to in ADDED.items():
            out[q].append(("R", REROLE_COST + more, to))
    return out


@functools.cache
def power(symbol: str, k: int) -> Matrix:
    """Min-plus matrix of 2^k rows of one symbol, with what is added before each."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    row = [[NEVER] * 4 for _ in range(4)]
    for q, options in _options(symbol).items():
        for _, cost, to in options:
            row[q][to] = min(row[q][to], cost)
    return _product(INSERTS, tuple(map(tuple, row)))


def _before(symbol: str, length: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs from before a run, given those after it."""
    k = 0
    while length:
        if length & 1:
            costs = _times(power(symbol, k), costs)
        length >>= 1
        k += 1
    return costs


@functools.lru_cache(1 << 14)
def _row(symbol: str, state: int, costs: tuple[int, ...]) -> tuple[str, int]:
    """Edits of one row, what is added before it included, and the state after, given the least costs after it."""
    done = ""
    here = _times(power(symbol, 0), costs)
    while True:
        options = [(edit, cost + costs[to], to) for edit, cost, to in _options(symbol)[state]]
        options.append(("I", INSERT_COST + here[ADDED[state]], ADDED[state]))
        edit, _, state = min(x for x in options if x[1] == here[state])
        done += edit
        if edit != "I":
            return done, state


def _unroll(symbol: str, length: int, state: int, costs: tuple[int, ...], out: list[str]) -> int:
    """Appends the edits of each row of a run; returns the state after it."""
    if length == 1:
        least = min(costs)
        edits, state = _row(symbol, state, tuple(c - least for c in costs))
        out.append(edits)
        return state
    half = 1 << (length.bit_length() - 1) if length & (length - 1) else length >> 1
    state = _unroll(symbol, half, state, _before(symbol, length - half, costs), out)
    return _unroll(symbol, length - half, state, costs, out)


def solve(runs: tuple[tuple[str, int], ...]) -> tuple[int, int, list[str], str]:
    """(illegal neighbours, cost, edits of each row, edits after the last row) of a conversation's runs."""
    costs = [END]
    for symbol, length in reversed(runs):
        costs.append(_before(symbol, length, costs[-1]))
    costs.reverse()
    state, edits = START, []
    for (symbol, length), after in zip(runs, costs[1:]):
        state = _unroll(symbol, length, state, after, edits)
    tail = "I" * (END[state] // INSERT_COST)
    pairs = [a[0][:-1] + b[0][:-1] for a, b in zip(runs, runs[1:])]
    alike = sum(n - 1 for _, n in runs)  # no role follows itself
    return sum(p not in ("su", "ua", "au") for p in pairs) + alike, costs[0][START], edits, tail


@functools.lru_cache(1 << 12)
def solved(runs: tuple[tuple[str, int], ...]) -> tuple[int, int, list[str], str]:
    """solve(), with short conversations remembered."""
    return solve(runs)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the checksum of `conv_id:turn`, modulo 20."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def ordered(conversations: DataFrame) -> DataFrame:
    """Distinct rows in the order of their conversations: conv_id, turn, role, text, pos (ascending), copies, and of the first
    copy and the others the fault (blank, duplicate, truncated or null)."""
    filled = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = filled.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    # the first turn of each role and text, null before all; a join, as one text may stand in any number of turns
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("x")).agg(F.min(F.struct("turn")).alias("least"))
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("x")))
    first = F.col("turn").eqNullSafe(F.col("least.turn"))
    last = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    blank = last == ""
    fault = F.when(blank, "blank").when(~first, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    listed = met.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), F.when(blank, "blank").otherwise("duplicate").alias("again"))
    placed = listed.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text").withColumn("pos", F.monotonically_increasing_id())
    return cut(placed, "conversations")


def _symbols(rows: DataFrame) -> DataFrame:
    fault = lambda c: F.when(F.col(c).isin("blank", "duplicate"), GONE).when(F.col(c) == "truncated", CUT).otherwise(SOUND).cast("string")
    initial = F.substring("role", 1, 1)
    return rows.select("conv_id", "pos", F.concat(initial, fault("fault")).alias("symbol"), F.concat(initial, F.lit(str(GONE))).alias("more"), "copies")


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, list[tuple], bool]]:
    """(conv_id, rows, whether they are its last) of sorted batches: a conversation's rows in as many parts as batches."""
    held, key = None, None
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in columns]
        ids, at = lists[0], 0
        while at < len(ids):
            to = at + 1
            while to < len(ids) and ids[to] == ids[at]:
                to += 1
            if held is not None:
                yield key, held, key != ids[at]
            key, held, at = ids[at], list(zip(*(x[at:to] for x in lists[1:]))), to
    if held is not None:
        yield key, held, True


def decided(rows: DataFrame) -> DataFrame:
    """Per row of ordered(): what is added before it and, after the last row, behind (states' initials), the edit of its
    first copy and the role it gets; on the last row of a conversation also illegal, cost and audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, places, out = [], [], []

        def add(symbol: str, n: int) -> None:
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += n
            elif n:
                runs.append([symbol, n])

        def flush() -> Iterator[pa.RecordBatch]:
            names = ["pos", "before", "edit", "new_role", "behind", "conv_id", "illegal", "cost", "audit"]
            kinds = [pa.int64(), *[pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())], ids or pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield from pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names).to_batches()
            out.clear()

        ids = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv_id").type
                yield batch

        for conv, part, last in _conversations(typed(), ["conv_id", "pos", "symbol", "more", "copies"]):
            for pos, symbol, more, copies in part:
                places.append((pos, copies))
                add(symbol, 1)
                add(more, copies - 1)
            if not last:
                continue
            key = tuple(map(tuple, runs))
            illegal, cost, edits, tail = (solved if len(key) <= 64 and sum(n for _, n in key) <= 256 else solve)(key)
            state, at = START, 0
            symbols = (s for s, n in runs for _ in range(n))
            for i, (pos, copies) in enumerate(places):
                before, edit, role = [], None, None
                for copy in range(copies):
                    symbol = next(symbols)
                    for e in edits[at]:
                        if e == "I":
                            state = ADDED[state]
                            before.append(ROLES[state])
                        elif not copy:
                            edit = e
                            if e == "K":
                                state = AFTER[symbol[:-1]][state]
                            elif e == "R":
                                state = ADDED[state]
                                role = ROLES[state]
                    at += 1
                behind = []
                done = i == len(places) - 1
                if done:
                    for _ in tail:
                        state = ADDED[state]
                        behind.append(ROLES[state])
                # a repeat is deleted before anything is added: D comes first in ASCII
                out.append((pos, before, edit, role, behind, conv, *((illegal, cost, "".join(edits) + tail) if done else (None, None, None))))
                if len(out) >= 4096:
                    yield from flush()
            runs.clear(), places.clear()
        if out:
            yield from flush()

    symbols = _symbols(rows).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return symbols.mapInArrow(decide, f"pos long, before array<string>, edit string, new_role string, behind array<string>, conv_id {kind}, illegal long, cost long, audit string")


def lines(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, pos, line, place) of the repaired conversations: `role:text`, in order of pos and place."""
    own = F.when(F.col("edit") == "K", F.concat("role", F.lit(":"), "text")).when(F.col("edit") == "R", F.concat("new_role", F.lit(":"), "text"))
    empty = lambda c: F.transform(c, lambda r: F.concat(r, F.lit(":")))
    all_lines = F.concat(empty("before"), F.when(own.isNull(), F.array().cast("array<string>")).otherwise(F.array(own)), empty("behind"))
    return rows.join(edits.drop("conv_id"), "pos").select("conv_id", "pos", F.posexplode(all_lines).alias("place", "line"))


def _hashed(found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): lines joined by new lines and hashed as they pass, sorted by Spark."""
    kind = found.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, sum_ = None, [], None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv_id").type
                yield batch

        for conv, part, last in _conversations(typed(), ["conv_id", "line"]):
            for (line,) in part:
                if sum_ is None:
                    sum_ = hashlib.sha256()
                else:
                    sum_.update(b"\n")
                sum_.update(line.encode())
            if last:
                out.append((conv, sum_.hexdigest()))
                sum_ = None
        if out:
            yield from pa.table([pa.array(x, k) for x, k in zip(zip(*out), (ids, pa.string()))], ["conv_id", "repaired_sha256"]).to_batches()

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "place").select("conv_id", "line").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired lines) of conversations (conv_id, turn, role, text): the report has one row per conversation with
    gaps in its turns, counts of faults, illegal neighbours, the cost and audit of the edits, and the hash of the result."""
    small_batches(conversations.sparkSession)
    rows = ordered(conversations)
    edits = cut(decided(rows), "edits")
    found = lines(rows, edits)
    times = lambda name: F.sum(F.when(F.col("fault") == name, 1).otherwise(0) + F.when(F.col("again") == name, F.col("copies") - 1).otherwise(0))
    by_turn = rows.groupBy("conv_id", "turn").agg(*[times(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    whole = edits.where("audit is not null").select("conv_id", "illegal", "cost", "audit")
    report = counts
    for other in (whole, _hashed(found)):
        named = other.withColumnRenamed("conv_id", "c")
        report = report.join(named, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return report.withColumn("repaired_sha256", _or_empty("repaired_sha256")), found


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.sha2(F.lit(""), 256))


def report_all(conversations: DataFrame, damaged_rows: DataFrame) -> DataFrame:
    """The report of the damaged rows, with every original conversation: zeros where no row is left."""
    report = repair(damaged_rows)[0].withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct()
    joined = every.join(report, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), _or_empty("repaired_sha256").alias("repaired_sha256"))
