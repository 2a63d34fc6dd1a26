"""Repair of conversations by signatures: faults and roles become short strings, each distinct one is solved once.

A conversation's rows are put in order by one range partitioning, so that even a conversation of a third of all rows is
many tasks' work, and cut into segments of SEGMENT rows at most. A segment's signature has one letter a row. Each
distinct signature is solved once by memoised recursion over (row, state of the role pattern); what follows a segment
enters by the costs of the four states at its end. The cheapest edits are joined back to the segments and replayed over
the rows, which stream by in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_checked, stored

#: Rows of a segment.
SEGMENT = 1 << 10
#: What keeping, giving another role, deleting and inserting cost, and keeping a truncated row besides. Fixed values.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a; and of each the state after s, u and a.
STATES = 4
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Inserts that end the pattern from each state.
CLOSING = (0, 2, 1, 0)
FAR = 1 << 60
#: Letters of a signature: rows to be deleted; rows of a role by its initial, in capitals if truncated.
GONE, OTHER = "x", "o"


def turn_of(state: int) -> str:
    """The role that comes next by the pattern, if it isn't s."""
    return "a" if state == 2 else "u"


def solve(signature: str, after: tuple[int, ...]) -> list[tuple[int, str, int, list[str]]]:
    """For each state before the signature its cheapest edits, ties to the least audit: (cost, audit, state after it, plays).

    after: what the rest costs from each state. plays is the audit letter by letter of the signature, as it is replayed:
    U and A for inserted roles, then k (keep), u or a (new role) or d (delete).
    """
    n = len(signature)
    memo: dict[tuple[int, int], tuple] = {}

    def best(i: int, state: int) -> tuple:
        """(cost with what follows, audit, state at the end, play, state after row i)."""
        if i == n:
            return after[state], "", state, "", state
        if (i, state) in memo:
            return memo[i, state]
        letter = signature[i]
        late = TRUNCATED if letter.isupper() else 0
        found = None
        at, play = state, ""
        for inserts in range(3):
            options = [("D", DELETE, at, "d")]
            if letter != GONE:
                kept = NEXT.get(letter.lower(), (None,) * STATES)[at]
                if kept is not None:
                    options.append(("K", KEEP + late, kept, "k"))
                role = turn_of(at)
                options.append(("R", REROLE + late, NEXT[role][at], role))
            for edit, cost, to, how in options:
                rest = best(i + 1, to)
                mine = (inserts * INSERT + cost + rest[0], "I" * inserts + edit + rest[1], rest[2], play + how, to)
                if found is None or mine[:2] < found[:2]:
                    found = mine
            role = turn_of(at)
            play, at = play + role.upper(), NEXT[role][at]
        memo[i, state] = found
        return found

    for i in range(n, -1, -1):  # from the end, so that recursion is never deep
        for state in range(STATES):
            best(i, state)
    out = []
    for state in range(STATES):
        cost, audit, end = best(0, state)[:3]
        plays, at = [], state
        for i in range(n):
            plays.append(best(i, at)[3])
            at = best(i, at)[4]
        out.append((min(cost - after[end], FAR), audit, end, plays))
    return out


def crossing(signature: str) -> list[int]:
    """What the signature costs from each state to each state, row by row."""
    out = []
    for end in range(STATES):
        after = tuple(0 if s == end else FAR for s in range(STATES))
        out.append([min(cost, FAR) if to == end else FAR for cost, _, to, _ in solve(signature, after)])
    return [out[end][state] for state in range(STATES) for end in range(STATES)]


ENDING = tuple(INSERT * c for c in CLOSING)


def _bounded(costs: list[int]) -> list[int]:
    """Costs less their least, those out of reach as FAR."""
    least = min(costs)
    return [min(c - least, FAR) if c < FAR else FAR for c in costs]


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """Rows fn(*values) for each row of df, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            rows = [fn(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)


def blank(c: Column) -> Column:
    return ~c.rlike(r"[^\x20\x09-\x0D]")


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): the rows as they are, null roles and texts read as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), name(role).alias("role"), name(text).alias("text"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): the rows with faults put in by crc32(`conv:turn`) % 20, nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes the text's `.`, `!` and `?`, 3 makes a second copy, 4 sets role user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    made = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), name(role).alias("role"), name(text).alias("text"), h.alias("h")).where("h <> 0")
    changed = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return made.select("conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies, at, segment, fault, code): equal rows once, numbered in order of turn, role, hash of the text.

    code is the row's letter; of its copies all but the first are to be deleted. Rows of a segment are neighbours.
    """
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    rows = rows.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = stored(rows.repartitionByRange("conv", "turn", "role", "same").sortWithinPartitions("conv", "turn", "role", "same").withColumn("at", F.monotonically_increasing_id()), "ordered")
    first = rows.groupBy(F.col("conv").alias("of"), F.col("same").alias("like")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("of", "like", "first"), "first")
    again = stored(join_checked(rows.select("conv", "same", "at"), first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("same") == F.col("like"))).where("at > first").select("at"), "again")
    rows = join_checked(rows.drop("same"), again.withColumn("again", F.lit(True)), "at", "left")
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin(*NEXT), initial).otherwise(F.lit(OTHER))
    fault = F.when(blank(F.col("text")), "blank").when(F.col("again"), "duplicate").when(~tail.isin(".", "!", "?"), "truncated").otherwise("")
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return rows.withColumn("fault", fault).select("conv", "turn", "role", "text", "copies", "at", F.shiftright("at", SEGMENT.bit_length() - 1).alias("segment"), "fault", code.alias("code"))


def solved(rows: DataFrame) -> DataFrame:
    """(conv, segment, ends, audits), stored: of each segment the solutions from each state, by its signature."""
    letters = F.array_sort(F.collect_list(F.struct("at", F.concat("code", F.when((F.col("copies") > 1) & (F.col("code") != GONE), GONE).otherwise("")).alias("c"))))
    segments = stored(rows.groupBy("conv", "segment").agg(letters.alias("l")).select("conv", "segment", F.array_join(F.transform("l", lambda x: x.c), "").alias("signature")), "segments")
    several = stored(segments.groupBy(F.col("conv").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of"), "several")
    plain = F.array(*[F.lit(c).cast("long") for c in ENDING])
    if several.isEmpty():
        asked = segments.withColumn("after", plain)
    else:  # what follows a segment: costs go back through the segments of its conversation
        long = join_checked(segments, several, F.col("conv").eqNullSafe(F.col("of")), "left_semi")
        costs = stored(mapped(stored(long.select("signature").distinct(), "distinct"), lambda s: (s, crossing(s)), "signature string, costs array<long>"), "crossings")
        chain = join_checked(stored(long, "long"), costs, "signature").select("conv", "segment", "costs").repartition("conv").sortWithinPartitions("conv", F.desc("segment"))
        kind = chain.schema["conv"].dataType.simpleString()
        after = stored(chain.mapInArrow(_backwards, f"of {kind}, part long, after array<long>"), "after")
        asked = join_checked(segments, after, F.col("conv").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("part")), "left").select("conv", "segment", "signature", F.coalesce("after", plain).alias("after"))
    asked = stored(asked, "asked")

    def answer(signature: str, after: list[int]):
        each = solve(signature, tuple(after))
        return signature, after, [x[2] for x in each], [x[3] for x in each]

    answers = stored(mapped(stored(asked.select("signature", "after").distinct(), "signatures"), answer, "signature string, after array<long>, ends array<int>, audits array<array<string>>"), "answers")
    return stored(join_checked(asked, answers, ["signature", "after"]).select("conv", "segment", "ends", "audits"), "solved")


def _backwards(batches):
    """Segments (conv, segment, costs) come last one first; yields what the rest of the conversation costs after each."""
    last, costs = object(), []
    for batch in batches:
        after = []
        for conv, own in zip(batch["conv"].to_pylist(), batch["costs"].to_pylist(), strict=True):
            if conv != last:
                last, costs = conv, list(ENDING)
            after.append(costs)
            costs = _bounded([min(own[STATES * s + e] + costs[e] for e in range(STATES)) for s in range(STATES)])
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["segment"].cast(pa.int64()), pa.array(after, pa.list_(pa.int64()))], names=["of", "part", "after"])


ROLES = {"u": "user", "a": "assistant"}


def replayed(rows: DataFrame, solutions: DataFrame, emit, schema: str) -> DataFrame:
    """What emit makes of each conversation's Replay, in order; rows and solutions meet in one sorted stream.

    emit: a class with row(replay, turn, role, text) for each repaired row and end(replay), each of which yields output rows.
    """
    none = lambda kind: F.lit(None).cast(kind)
    lines = rows.select("conv", "segment", "at", "turn", "role", "text", "copies", "fault", "code", none("array<int>").alias("ends"), none("array<array<string>>").alias("audits"))
    heads = solutions.select("conv", "segment", F.lit(-1).cast("long").alias("at"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("copies"), none("string").alias("fault"), none("string").alias("code"), "ends", "audits")
    stream = lines.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "segment", "at")
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        open_, made = None, []
        for batch in batches:
            for some in range(0, batch.num_rows, 256):
                for conv, _, at, *values in zip(*(c.to_pylist() for c in batch.slice(some, 256).columns), strict=True):
                    if open_ is None or open_.conv != conv:
                        if open_ is not None:
                            made += open_.end()
                        open_ = Replay(conv, emit)
                    made += open_.head(*values[-2:]) if at < 0 else open_.line(*values[:-2])
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)
                    made = []
        if open_ is not None and (made := list(open_.end())):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return stream.mapInArrow(run, out)


class Replay:
    """One conversation: rows are given in order, each segment's solutions before its rows."""

    def __init__(self, conv, emit):
        self.conv, self.emit, self.state, self.plays = conv, emit(), 0, iter(())
        self.audit: list[str] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = self.turn = None
        self.turns, self.last = 0, None

    def head(self, ends, audits) -> list[tuple]:
        """The solutions of the rows that come next; the state after the rows before selects one."""
        self.plays, self.state = iter(audits[self.state]), ends[self.state]
        return []

    def line(self, turn, role, text, copies, fault, code) -> list[tuple]:
        c = self.counts
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        if fault:
            c[fault] += copies if fault != "truncated" else 1
        if fault in ("", "truncated"):
            c["duplicate"] += copies - 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            c["illegal"] += 1
        c["illegal"] += copies - 1
        self.last = initial
        out = []
        for edit in next(self.plays):
            if edit in "UA":
                self.audit.append("I")
                c["cost"] += INSERT
                out += self.emit.row(self, turn, ROLES[edit.lower()], "")
            elif edit == "d":
                times = copies if code == GONE else 1
                self.audit.append("D" * times)
                c["cost"] += DELETE * times
            else:
                self.audit.append("K" if edit == "k" else "R")
                c["cost"] += (KEEP if edit == "k" else REROLE) + (TRUNCATED if fault == "truncated" else 0)
                out += self.emit.row(self, turn, role if edit == "k" else ROLES[edit], text)
        if code != GONE and copies > 1:
            for edit in next(self.plays):  # the copies' own place in the signature
                if edit == "d":
                    self.audit.append("D" * (copies - 1))
                    c["cost"] += DELETE * (copies - 1)
                else:
                    self.audit.append("I")
                    c["cost"] += INSERT
                    out += self.emit.row(self, turn, ROLES[edit.lower()], "")
        return [(self.conv, *x) for x in out]

    def end(self) -> list[tuple]:
        out = []
        for role in ("u", "a")[2 - CLOSING[self.state] :]:
            self.audit.append("I")
            self.counts["cost"] += INSERT
            out += self.emit.row(self, self.turn, ROLES[role], "")
        return [(self.conv, *x) for x in (*out, *self.emit.end(self))]


class _Rows:
    """Emits the repaired rows, numbered."""

    def __init__(self):
        self.place = -1

    def row(self, replay, turn, role, text):
        self.place += 1
        return [(self.place, turn, role, text)]

    def end(self, replay):
        return []


class _Report:
    """Emits one row of counts, the audit and the hash of the repaired conversation."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def row(self, replay, turn, role, text):
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True
        return []

    def end(self, replay):
        gaps = replay.high - replay.low + 1 - replay.turns if replay.turns else 0
        return [(min(gaps, (1 << 63) - 1), *replay.counts.values(), "".join(replay.audit), self.hash.hexdigest())]


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, place, turn, role, text): the repaired conversations of rows (conv, turn, role, text, copies), numbered from 0.

    An inserted row has an empty text and the turn before which it stands. See report().
    """
    rows = stored(ordered(rows), "rows")
    return replayed(rows, solved(rows), _Rows, "place long, turn long, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv, turn, role, text, copies): its faults, its cheapest edits and their result.

    Rows stand in order of turn (nulls first), then role, then a hash of role and text, equal rows side by side. A row's first fault
    counts: blank, duplicate (role and text stood earlier), truncated (doesn't end in `.`, `!` or `?`). Roles count by
    their first letter; one that isn't s, u or a can only be given another role or deleted. Columns: conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256. Roles and texts mustn't be null, conv and turn may be:
    rows of a null conv are one conversation. Texts are read whole. An empty table gives an empty result. A conversation's rows are sorted,
    judged and solved by many tasks; its hash alone needs them one after another, and streams them.
    """
    rows = stored(ordered(rows), "rows")
    return replayed(rows, solved(rows), _Report, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def report_damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """report() after damaged(), for every conversation of rows: one of which no row is left has zeros and empty results."""
    every = rows.select(F.col(conv).alias("every")).distinct()
    made = stored(report(damaged(rows, conv, turn, role, text)), "report")
    left = join_checked(every, made, F.col("every").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("every", "conv")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return left.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}).withColumnRenamed("conv", conv)
