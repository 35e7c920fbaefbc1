"""Operator 11: conversation structure repair by error-correcting Earley parsing.

A role grammar says what a conversation is: nothing, or an optional system row and then
user and assistant rows in turn. Its productions for errors have a price: a row is deleted
or gets another role, an empty one is inserted. The grammar is left-linear, so all chart
items begin at the first row and a chart set is one dict: for each nonterminal the least
(cost, audit) with which it derives the rows so far. The completed chart's least item is
the repair; its audit says what to do with each row.

Conversations of up to LONG rows are dealt by conv_id and repaired as they stream by. A
longer one is split over range partitions in its order. Each partition parses what it has
from every nonterminal, in segments whose charts are joined pairwise, and gives one chart
from nonterminal to nonterminal; those are joined in order. Its repeated messages are found
with the group spread first, so one conversation or message with a third of all rows is
split too. Only the hash of a repaired conversation, which sha256 takes in order, and its
audit, which is one value of the result, are made in one task; that task streams.

Defined results: a null conv_id is a conversation; a null role or text is one space, and so
is a null conv_id or turn in the text that decides on the damage; rows of one turn stand
by role and a hash of their text, and the audit follows that order; a row whose role is
empty or has another initial than s, u or a can't be kept as it is; rows of equal role and
text repeat each other whatever their turns;
very long texts are read whole; extra columns are ignored; an empty table gives no row. A
conversation that loses all rows is the empty one: zeros and the hash of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

LONG, SEGMENT, FEW, SALTS = 256, 256, 100_000, 64
SPACE = " \t\n\x0b\x0c\r"
NAMES = {"s": "system", "u": "user", "a": "assistant"}

#: Nonterminals: E has no row yet, S ends with a system row, U with a user's, A with an assistant's. A conversation is E or A.
STATES = "ESUA"
#: (nonterminal, nonterminal before, what follows it): the grammar.
RULES = (("S", "E", "s"), ("U", "E", "u"), ("U", "S", "u"), ("U", "A", "u"), ("A", "U", "a"))
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
Item = tuple[int, str]  # (cost, audit)
Chart = dict[str, Item]


def _scans() -> dict[str, list[tuple[str, str, int, str]]]:
    """For each kind of row (its initial, x for any other; upper case if truncated; d if it must go): (nonterminal, before, price, letter)."""
    out = {}
    for kind in "suaxSUAXd":
        own = [(x, x, DELETE, "D") for x in STATES]
        for to, before, role in RULES if kind != "d" else ():
            more = UNFINISHED * kind.isupper()
            if kind.lower() == role:
                own.append((to, before, more, "K"))
            elif role in "ua":
                own.append((to, before, REROLE + more, "R"))
        out[kind] = own
    return out


_SCANS = _scans()


def parsed(kinds: str, start: str = "E") -> Chart:
    """The chart after the rows of these kinds, from an item of ``start`` that has cost nothing."""

    def put(to: str, item: Item) -> None:
        if to not in chart or item < chart[to]:
            chart[to] = item

    def inserted() -> None:
        for to, before, role in (*RULES, RULES[-1]):
            if role in "ua" and before in chart:
                cost, audit = chart[before]
                put(to, (cost + INSERT, audit + "I"))

    chart: Chart = {start: (0, "")}
    inserted()
    for kind in kinds:
        last, chart = chart, {}
        for to, before, price, letter in _SCANS[kind]:
            if before in last:
                cost, audit = last[before]
                put(to, (cost + price, audit + letter))
        inserted()
    return chart


def joined(first: dict[str, Chart], then: dict[str, Chart]) -> dict[str, Chart]:
    """Charts from each nonterminal, of rows and of the rows after them, as those of all.

    Equal costs for the same rows never have audits of which one begins the other, as both have
    a letter for each row and an insert costs; so the least audits of the parts make the least audit.
    """
    out: dict[str, Chart] = {}
    for start, chart in first.items():
        own: dict[str, tuple[int, list[tuple[str, str]]]] = {}
        for middle, (cost, audit) in chart.items():
            for end, (more, rest) in then[middle].items():
                total = cost + more
                if end not in own or total < own[end][0]:
                    own[end] = (total, [(audit, rest)])
                elif total == own[end][0]:
                    own[end][1].append((audit, rest))
        out[start] = {end: (cost, min(a + b for a, b in ways)) for end, (cost, ways) in own.items()}
    return out


def least(chart: Chart) -> Item:
    return min(chart[x] for x in "EA" if x in chart)


def repaired(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The rows (role, text) that an audit makes of rows."""
    state, rows = "E", iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == "U" else "user"
        state = role[:1].upper()
        yield role, text


def digest(rows: Iterable[tuple[str, str]], audit: str) -> str:
    h, between = hashlib.sha256(), b""
    for role, text in repaired(rows, audit):
        h.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        between = b"\n"
    return h.hexdigest()


class Faults:
    """Counts of a run of rows in order, which add up."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self, rows=0, blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, first="", last=""):
        self.rows, self.blank, self.duplicate, self.truncated, self.illegal = rows, blank, duplicate, truncated, illegal
        self.turns, self.low, self.high, self.first, self.last = turns, low, high, first, last

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> str:
        """Count a row, and give its kind for the parser."""
        own = Faults(rows=1, first=role[:1], last=role[:1], turns=int(turn is not None), low=turn, high=turn)
        body = text.rstrip(SPACE)
        kind = role[:1] if role[:1] in NAMES else "x"
        if not body:
            own.blank, kind = 1, "d"
        elif seen:
            own.duplicate, kind = 1, "d"
        elif body[-1] not in ".!?":
            own.truncated, kind = 1, kind.upper()
        self.extend(own)
        return kind

    def extend(self, other: Faults) -> None:
        if self.rows and other.rows:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        if self.turns and other.turns:
            self.turns -= self.high == other.low
        if other.rows:
            self.first, self.last = self.first if self.rows else other.first, other.last
        if other.turns:
            self.low, self.high = self.low if self.turns else other.low, other.high
        for f in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, f, getattr(self, f) + getattr(other, f))

    def result(self) -> list[int]:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ORDER = ["conv_id", "turn", "role", "mark", "text", "rid", "copy"]  # ascending puts nulls first


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live, rid, copy, mark) after the damage; a row that is dropped stays as one without role and text that is not live."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumn("fate", F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20)
    gone = F.col("fate") == 0
    text = F.when(gone, None).when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(gone, None).when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (~gone).alias("live"), "rid", F.explode(copies).alias("copy")).withColumn("mark", F.xxhash64("text"))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of few rows, whole."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _RESULT]
        held: list[tuple] = []
        now: tuple | None = None

        def close() -> None:
            faults, seen, kinds = Faults(), set(), []
            for turn, role, text in held:
                kinds.append(faults.add(turn, role, text, (role, text) in seen))
                seen.add((role, text))
            cost, audit = least(parsed("".join(kinds)))
            own = [(role, text) for _, role, text in held]
            for column, x in zip(out, [now[0], *faults.result(), cost, audit, digest(own, audit)], strict=True):
                column.append(x)
            held.clear()

        for batch in batches:
            for conv, turn, role, text, live in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "live")], strict=True):
                if now != (conv,):
                    if now is not None:
                        close()
                    now = (conv,)
                if live:
                    held.append((turn, role, text))
            if len(out[0]) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _RESULT, strict=True)], schema=_RESULT)
                out = [[] for _ in _RESULT]
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _RESULT, strict=True)], schema=_RESULT)

    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*_ORDER).mapInArrow(each, RESULT)


def _seen(rows: DataFrame) -> DataFrame:
    """rows with ``seen``: an earlier row of the conversation has the same role and text.

    The first row of each of SALTS parts of a group is found, then the first of those.
    """
    key, order = ["conv_id", "role", "text"], ["turn", "rid", "copy"]
    part = F.pmod(F.xxhash64("rid", "copy"), F.lit(SALTS))
    rows = rows.withColumn("part", part).withColumn("first", F.row_number().over(Window.partitionBy(*key, "part").orderBy(*order)) == 1)
    rows = rows.withColumn("part", F.when(F.col("first"), F.lit(-1)).otherwise(F.col("part")))
    first = F.row_number().over(Window.partitionBy(*key, "part").orderBy(*order)) == 1
    return rows.withColumn("seen", ~(F.col("first") & first)).drop("part", "first")


_PIECE = "conv_id long, pid int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, costs array<long>, audits array<string>"


def _pieces(rows: DataFrame) -> DataFrame:
    """For each conversation and range partition that has rows of it: its counts, and costs and audits from each nonterminal to each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, now = TaskContext.get().partitionId(), None
        faults, kinds, stack = Faults(), [], []

        def parse() -> None:
            """The held kinds become a chart; as in a counter, two of one height are joined to one of the next."""
            if not kinds:
                return
            height, own = 0, {x: parsed("".join(kinds), x) for x in STATES}
            while stack and stack[-1][0] <= height:
                height, own = stack[-1][0] + 1, joined(stack.pop()[1], own)
            stack.append((height, own))
            kinds.clear()

        def close() -> pa.RecordBatch:
            parse()
            own = stack.pop()[1]
            while stack:
                own = joined(stack.pop()[1], own)
            items = [own[a].get(b, (None, None)) for a in STATES for b in STATES]
            row = {"conv_id": now[0], "pid": pid, **{f: getattr(faults, f) for f in Faults.FIELDS}, "costs": [c for c, _ in items], "audits": [a for _, a in items]}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for conv, turn, role, text, seen in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen")], strict=True):
                if now != (conv,):
                    if now is not None:
                        yield close()
                    now, faults = (conv,), Faults()
                kinds.append(faults.add(turn, role, text, seen))
                if len(kinds) == SEGMENT:
                    parse()
        if now is not None:
            yield close()

    kinds_ = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds_[k]) for n, k in (x.split() for x in _PIECE.split(", "))])
    n = partitions(rows.sparkSession)
    return rows.repartitionByRange(n, "conv_id", "turn", "role", "mark", "rid", "copy").sortWithinPartitions(*_ORDER).select("conv_id", "turn", "role", "text", "seen").mapInArrow(each, _PIECE)


def _wholes(pieces: DataFrame) -> DataFrame:
    """Conversations from their pieces, without the hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, faults, chart = None, Faults(), {}
        schema = pa.schema(list(_RESULT)[:-1])

        def close() -> pa.RecordBatch:
            cost, audit = least(chart["E"])
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([now[0], *faults.result(), cost, audit], schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if now != (row["conv_id"],):
                    if now is not None:
                        yield close()
                    now, faults, chart = (row["conv_id"],), Faults(), {"E": {"E": (0, "")}}
                faults.extend(Faults(**{f: row[f] for f in Faults.FIELDS}))
                items = dict(zip([(a, b) for a in STATES for b in STATES], zip(row["costs"], row["audits"], strict=True), strict=True))
                chart = joined(chart, {a: {b: items[a, b] for b in STATES if items[a, b][0] is not None} for a in STATES})
        if now is not None:
            yield close()

    kinds = RESULT.rsplit(", ", 1)[0]
    return pieces.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pid").mapInArrow(each, kinds)


def _digests(rows: DataFrame, wholes: DataFrame) -> DataFrame:
    """wholes with the hash of the repaired rows, which stream in order behind the audit."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")], strict=True)

        stream = conversations()
        head = next(stream, None)
        while head is not None:
            conv, after = head[0], []

            def own(conv: int | None = conv, after: list = after) -> Iterator[tuple[str, str]]:
                for row in stream:
                    if row[0] != conv or row[3] is not None:
                        after.append(row)
                        return
                    yield row[1], row[2]

            rest = own()
            h = digest(rest, head[3])
            for _ in rest:  # rows at the end that no letter asked for: there are none
                pass
            head = after[0] if after else None
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "repaired_sha256": pa.array([h])})

    none = F.lit(None)
    heads = wholes.select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(-1).cast("long").alias("rid"), F.lit(0).alias("copy"), none.cast("long").alias("mark"), "audit")
    body = rows.select("conv_id", "turn", "role", "text", "rid", "copy", "mark", none.cast("string").alias("audit"))
    own = heads.union(body).withColumn("head", F.col("audit").isNull())
    own = own.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "head", *_ORDER[1:])
    return own.select("conv_id", "role", "text", "audit").mapInArrow(each, "conv_id long, repaired_sha256 string")


def repairs(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """One row for each conv_id: its faults after the damage, the cheapest repair's cost and audit, and the repaired text's hash."""
    sizes = conversations.groupBy(F.col("conv_id").cast("long").alias("id")).count()
    large = materialise(sizes.where(F.col("count") > long).select("id"))
    n = large.count()
    if not n:
        return _short(damaged(conversations))
    own = F.broadcast(large) if n <= FEW else large
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    rows = damaged(conversations)
    short = _short(rows.join(own, same, "left_anti"))
    live = materialise(_seen(rows.where("live").join(own, same, "left_semi")))
    wholes = materialise(_wholes(_pieces(live)))
    hashes = _digests(live, wholes)
    w, h = wholes.alias("w"), hashes.withColumnRenamed("conv_id", "own").alias("h")
    long_ = large.join(w, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(h, F.col("id").eqNullSafe(F.col("own")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return short.union(long_.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")))
