"""Repair of the structure of conversations, with the cheapest edits, by Hirschberg's divide and conquer.

A conversation must be nothing, or an optional system message and then user and assistant by turns. That is an
automaton of four states: START, after SYSTEM, after USER, after ASSISTANT. Each message is a matrix of what it costs
to come from one state to another with it; a stretch of messages is a matrix too. To rebuild the edits between two
states, the costs from the left and the costs from the right, a vector of four each, meet in the middle; the crossing
of the least sum is taken and both halves are solved for themselves. So no table of all messages by states is kept.

Among crossings of equal cost, the one with the ASCII-least edits wins. No edits need to be spelled out for that: the
edits of a stretch end with the one that takes its last message, so none of them begins another, and the first
difference decides. It is enough to carry, with the costs, the rank of each state's least edits among the four.

Conversations of any length are spread over tasks. Messages are put in order once, and windows of neighbouring ones
packed into runs of a conversation, two letters for a message. Matrices of runs are joined in a tree, a bounded number
in a task, up to the whole conversation; on the way down the same divide and conquer finds the states between them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.llm.batches import SLICE_BYTES, groups
from ledgerline.llm.ordering import in_order
from ledgerline.session import fresh_path, write_and_read

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60  # the cost of what cannot be
WINDOW_BITS = 10  # messages of a window: 1024 neighbouring ones
GROUP_BITS = 13  # matrices that a task joins at a time: of windows whose positions share all but so many bits

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
AFTER_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
AFTER_NEW = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # a new or changed role is the one that may come
AT_THE_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # messages that must be added behind the last one
LEGAL = {"su", "ua", "au"}

Vector = tuple[tuple[int, int], ...]  # for each state its cost and the rank of its least edits
Matrix = tuple[tuple[tuple[int, int], ...], ...]  # for each state before, for each state behind: cost, rank


def _edits_of(role: str, fault: str) -> list[list[tuple[int, str]]]:
    """For a message of this role initial and fault, by state before and behind: the cost and the least edits."""
    out = [[(FAR, "")] * 4 for _ in range(4)]
    for before in range(4):
        state, cost, inserted = before, 0, ""
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if fault not in "bd":
                more = TRUNCATED if fault == "t" else 0
                ways.append((AFTER_NEW[state], REROLE + more, "R"))
                if (state, role) in AFTER_KEPT:
                    ways.append((AFTER_KEPT[state, role], KEEP + more, "K"))
            for behind, price, edit in ways:
                out[before][behind] = min(out[before][behind], (cost + price, inserted + edit))
            state, cost, inserted = AFTER_NEW[state], cost + INSERT, inserted + "I"
    return out


EDITS = {role + fault: _edits_of(role, fault) for role in "suax" for fault in ".bdt"}
_SPELLED = sorted({edits for ways in EDITS.values() for row in ways for _, edits in row})
MESSAGES: dict[str, Matrix] = {kind: tuple(tuple((cost, _SPELLED.index(edits)) for cost, edits in row) for row in ways) for kind, ways in EDITS.items()}


def _forward(vector: Vector, matrix: Matrix) -> Vector:
    """Costs and ranks behind what ``matrix`` stands for, from those before it."""
    best = [min((cost + row[behind][0], rank, row[behind][1]) for (cost, rank), row in zip(vector, matrix, strict=True)) for behind in range(4)]
    keys = sorted({key[1:] for key in best if key[0] < FAR})
    return tuple((key[0], keys.index(key[1:])) if key[0] < FAR else (FAR, 4) for key in best)


def _backward(matrix: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before what ``matrix`` stands for, from those behind it."""
    return tuple(min(FAR, min(cost + way for (cost, _), way in zip(row, costs, strict=True))) for row in matrix)


_NEXT: dict[tuple, tuple[int, Vector]] = {}
_BEFORE: dict[tuple, tuple[int, tuple[int, ...]]] = {}


def forward(stretch: Sequence[Matrix], start: int) -> Vector:
    """From ``start`` over the whole stretch. Costs relative to the least of a vector take few values, so steps repeat."""
    vector: Vector = tuple((0, 0) if state == start else (FAR, 4) for state in range(4))
    base = 0
    for matrix in stretch:
        key = (vector, id(matrix))
        step = _NEXT.get(key) if id(matrix) in _KEPT else None
        if step is None:
            after = _forward(vector, matrix)
            least = min(cost for cost, _ in after)
            step = least, tuple((cost - least if cost < FAR else FAR, rank) for cost, rank in after)
            if id(matrix) in _KEPT:
                _NEXT[key] = step
        base, vector = base + step[0], step[1]
    return tuple((cost + base if cost < FAR else FAR, rank) for cost, rank in vector)


def backward(stretch: Sequence[Matrix], end: int) -> tuple[int, ...]:
    """The costs from each state over the whole stretch to ``end``."""
    costs, base = tuple(0 if state == end else FAR for state in range(4)), 0
    for matrix in reversed(stretch):
        key = (costs, id(matrix))
        step = _BEFORE.get(key) if id(matrix) in _KEPT else None
        if step is None:
            before = _backward(matrix, costs)
            least = min(before)
            step = least, tuple(cost - least if cost < FAR else FAR for cost in before)
            if id(matrix) in _KEPT:
                _BEFORE[key] = step
        base, costs = base + step[0], step[1]
    return tuple(cost + base if cost < FAR else FAR for cost in costs)


_KEPT = {id(matrix) for matrix in MESSAGES.values()}  # the matrices of messages live as long as the module


def crossings(stretch: Sequence[Matrix], start: int, end: int) -> list[int]:
    """The states between the elements of the stretch, ``start`` and ``end`` included, on the least of the cheapest ways."""
    states = [start] * len(stretch) + [end]
    waiting = [(0, len(stretch))]
    while waiting:
        low, high = waiting.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        left, right = forward(stretch[low:middle], states[low]), backward(stretch[middle:high], states[high])
        states[middle] = min(range(4), key=lambda state: (left[state][0] + right[state], left[state][1]))
        waiting += [(low, middle), (middle, high)]
    return states


def whole(stretch: Sequence[Matrix]) -> Matrix:
    """The matrix of a stretch."""
    return tuple(forward(stretch, start) for start in range(4))


def last_state(vector: Vector) -> int:
    """Where the least of the cheapest ways to a legal end leaves the last message."""
    return min(range(4), key=lambda state: (vector[state][0] + INSERT * AT_THE_END[state], vector[state][1]))


def edits_between(kinds: Sequence[str], start: int, end: int) -> list[str]:
    """The edits for each message: inserted ones before it, then what becomes of it."""
    states = crossings([MESSAGES[kind] for kind in kinds], start, end)
    return [EDITS[kind][before][behind][1] for kind, before, behind in zip(kinds, states, states[1:], strict=False)]


@dataclass
class Repair:
    """``messages``: ``conv``, ``pos``, ``turn``, ``role``, ``text`` in order, as they came; ``runs``: what becomes of them, for
    neighbouring messages of a conversation: ``conv``, ``pos`` of the first, ``kinds`` (role initial and fault of each),
    ``state`` before the first, ``edits`` of all, in order; ``conversations``: ``conv`` of all that were asked for."""

    messages: DataFrame
    runs: DataFrame
    conversations: DataFrame


def damage(rows: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` of conversations with faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 makes its role
    user. A null role, text or part of the key is one space.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    fault = F.crc32(F.concat(_spaced(conv), F.lit(":"), _spaced(turn))) % 20
    text, role = _spaced(F.col("text")), _spaced(F.col("role"))
    broken = rows.select(
        conv.alias("conv"), turn.alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
    return broken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copy", "copies")


def _spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def repair(rows: DataFrame, conversations: DataFrame) -> Repair:
    """The cheapest edits of the conversations in ``rows`` (``conv``, ``turn``, ``role``, ``text``).

    Messages stand by turn, nulls first, then by role and the digest of their text; a null role or text is one space.
    Faults are blank, then duplicate (role and text seen earlier in the conversation), then truncated. Rows with a
    null ``conv`` are a conversation as any other. ``conversations`` has a column ``conv``, once each.
    """
    spark, conv_type = rows.sparkSession, rows.schema["conv"].dataType
    text = _spaced(F.col("text"))
    read = rows.select("conv", F.col("turn"), _spaced(F.col("role")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("same"))
    messages = in_order(read, ["conv", "turn", "role", "same"])
    firsts = messages.groupBy("conv", "role", "same").agg(F.min("pos").alias("pos"))
    initial = F.substring("role", 1, 1)
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = messages.select(
        F.shiftright("pos", WINDOW_BITS).alias("window"), "pos", F.lit(1).alias("kind"), "conv",
        F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), F.when(end == "", "b").when(end.isin(".", "!", "?"), ".").otherwise("t")).alias("message"),
    )
    marks = firsts.select(F.shiftright("pos", WINDOW_BITS).alias("window"), "pos", F.lit(0).alias("kind"), F.lit(None).cast(conv_type).alias("conv"), F.lit(None).cast("string").alias("message"))
    packed = T.StructType([T.StructField("conv", conv_type), T.StructField("pos", T.LongType()), T.StructField("kinds", T.StringType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window in groups(batches, ("window",)):
            convs, runs, first = [], [], -1
            for conv, pos, message in zip(*(window.column(c).to_pylist() for c in ("conv", "pos", "message")), strict=True):
                if message is None:
                    first = pos
                    continue
                if not convs or convs[-1] != conv:
                    convs.append(conv)
                    runs.append((pos, []))
                runs[-1][1].append(message if message[1] == "b" or pos == first else message[0] + "d")
            yield pa.RecordBatch.from_arrays(
                [pa.array(convs, window.schema.field("conv").type), pa.array([pos for pos, _ in runs], pa.int64()), pa.array(["".join(kinds) for _, kinds in runs], pa.string())],
                names=packed.names,
            )

    windows = narrow.unionByName(marks).repartition("window").sortWithinPartitions("window", "pos", "kind")
    runs = write_and_read(windows.mapInArrow(pack, packed), fresh_path(spark, "conversation-runs"))
    return Repair(messages.drop("same"), _solved(runs), conversations.select("conv"))


def _kinds(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(0, len(text), 2)]


def _flat(matrix: Matrix) -> list[int]:
    return [x for row in matrix for pair in row for x in pair]


def _square(flat: Sequence[int]) -> Matrix:
    return tuple(tuple((flat[8 * i + 2 * j], flat[8 * i + 2 * j + 1]) for j in range(4)) for i in range(4))


def _node(bits: int) -> Column:
    return F.shiftright("pos", min(bits, 63))


def _solved(runs: DataFrame) -> DataFrame:
    """``runs`` with ``state`` and ``edits``.

    A conversation that lies in one run is solved by itself. Those in several are joined in a tree: a node covers the
    positions that agree above some bits, so it has at most 2 ** GROUP_BITS nodes below it.
    """
    spark = runs.sparkSession
    parts = runs.groupBy("conv").agg(F.count(F.lit(1)).alias("parts"), F.min("pos").alias("of"), F.max("pos").alias("til")).where("parts > 1")
    parts = write_and_read(parts.withColumnRenamed("conv", "its_conv"), fresh_path(spark, "conversation-parts"))
    marked = runs.join(parts, F.col("conv").eqNullSafe(F.col("its_conv")), "left").select("conv", "pos", "kinds", "of", "til")
    long_ones = marked.where("of IS NOT NULL")
    matrices = "of long, pos long, matrix array<long>"

    def of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [_flat(whole([MESSAGES[kind] for kind in _kinds(kinds)])) for kinds in batch.column("kinds").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("pos"), pa.array(flat, pa.list_(pa.int64()))], names=["of", "pos", "matrix"])

    def of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, ("of", "node")):
            matrix = whole([_square(flat) for flat in own.column("matrix").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(own.column(c).slice(0, 1).combine_chunks() for c in ("of", "pos")), pa.array([_flat(matrix)], pa.list_(pa.int64()))], names=["of", "pos", "matrix"])

    levels = [write_and_read(long_ones.select("of", "pos", "kinds").mapInArrow(of_runs, matrices), fresh_path(spark, "conversation-nodes"))]
    while not levels[-1].where("pos != of").isEmpty():
        below = levels[-1].withColumn("node", _node(WINDOW_BITS + GROUP_BITS * len(levels)))
        above = below.repartition("of", "node").sortWithinPartitions("of", "node", "pos").mapInArrow(of_nodes, matrices)
        levels.append(write_and_read(above, fresh_path(spark, "conversation-nodes")))

    def at_the_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [last_state(_square(flat)[START]) for flat in batch.column("matrix").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("pos"), pa.array([START] * len(ends), pa.int32()), pa.array(ends, pa.int32())], names=["of", "pos", "state", "behind"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, ("of", "node")):
            below = own.slice(1)
            states = crossings([_square(flat) for flat in below.column("matrix").to_pylist()], own.column("state")[0].as_py(), own.column("behind")[0].as_py())
            yield pa.RecordBatch.from_arrays([*(below.column(c).combine_chunks() for c in ("of", "pos")), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], names=["of", "pos", "state", "behind"])

    states = levels[-1].mapInArrow(at_the_top, "of long, pos long, state int, behind int")
    for level in range(len(levels) - 1, 0, -1):
        node = _node(WINDOW_BITS + GROUP_BITS * level).alias("node")
        heads = states.select("of", node, F.lit(0).alias("kind"), "pos", F.lit(None).cast("array<long>").alias("matrix"), "state", "behind")
        below = levels[level - 1].select("of", node, F.lit(1).alias("kind"), "pos", "matrix", F.lit(None).cast("int").alias("state"), F.lit(None).cast("int").alias("behind"))
        both = heads.unionByName(below).repartition("of", "node").sortWithinPartitions("of", "node", "kind", "pos")
        states = write_and_read(both.mapInArrow(inside, states.schema), fresh_path(spark, "conversation-states"))
    known = marked.join(states.select(F.col("pos").alias("its_pos"), "state", "behind"), F.col("pos") == F.col("its_pos"), "left")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            befores, spelled = [], []
            for kinds, last, before, behind in zip(*(batch.column(c).to_pylist() for c in ("kinds", "last", "state", "behind")), strict=True):
                own = _kinds(kinds)
                if before is None:
                    before, behind = START, last_state(forward([MESSAGES[kind] for kind in own], START))
                befores.append(before)
                spelled.append("".join(edits_between(own, before, behind)) + "I" * (AT_THE_END[behind] if last else 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "pos", "kinds")), pa.array(befores, pa.int32()), pa.array(spelled, pa.string())], names=["conv", "pos", "kinds", "state", "edits"])

    last = F.coalesce(F.col("pos") == F.col("til"), F.lit(True)).alias("last")
    schema = T.StructType([*runs.schema, T.StructField("state", T.IntegerType()), T.StructField("edits", T.StringType())])
    solved = known.select("conv", "pos", "kinds", last, "state", "behind").mapInArrow(spell, schema)
    return write_and_read(solved, fresh_path(spark, "conversation-edits"))


_ONE = re.compile("I*[KRD]")
_STUB, _RUN, _MESSAGE = range(3)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Events of a stream by ``conv``, ``pos``, ``kind``: (kind, conv, pos, fields). Behind each message what was made of it.

    A stub announces a conversation; a run brings ``kinds`` and ``edits``; a message is followed in its event by the
    list of (edit, role, text) that stand in its place, the messages added behind the last one included.
    """
    edits: list[str] = []
    tail, state, at = "", START, 0
    for batch in batches:
        for kind, conv, pos, turn, role, text, kinds, before, spelled in zip(*(batch.column(c).to_pylist() for c in ("kind", "conv", "pos", "turn", "role", "text", "kinds", "state", "edits")), strict=True):
            if kind == _STUB:
                yield kind, conv, pos, ()
            elif kind == _RUN:
                edits, at, state = _ONE.findall(spelled), 0, before
                tail = spelled[sum(map(len, edits)) :]
                yield kind, conv, pos, (kinds, spelled)
            else:
                made = []
                own, at = edits[at], at + 1
                for edit in own + (tail if at == len(edits) else ""):
                    if edit == "D":
                        continue
                    if edit == "K":
                        state = AFTER_KEPT[state, role[:1]]
                        made.append((edit, role, text))
                    else:
                        state = AFTER_NEW[state]
                        made.append((edit, "user" if state == USER else "assistant", "" if edit == "I" else text))
                yield kind, conv, pos, (turn, made)


def _stream(repaired: Repair, whole_conversations: bool) -> DataFrame:
    schema = repaired.messages.schema
    nothing = {"turn": schema["turn"].dataType, "role": T.StringType(), "text": T.StringType(), "kinds": T.StringType(), "state": T.IntegerType(), "edits": T.StringType()}

    def part(df: DataFrame, kind: int, pos: Column) -> DataFrame:
        return df.select("conv", pos.alias("pos"), F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()))

    rows = part(repaired.runs, _RUN, F.col("pos")).unionByName(part(repaired.messages, _MESSAGE, F.col("pos")))
    if whole_conversations:
        rows = rows.unionByName(part(repaired.conversations, _STUB, F.lit(-1).cast("long")))
        return rows.repartition("conv").sortWithinPartitions("conv", "pos", "kind")
    return rows.withColumn("window", F.shiftright("pos", WINDOW_BITS)).repartition("window").sortWithinPartitions("window", "pos", "kind").drop("window")


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; the generator is not read ahead."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > SLICE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _with_conv(rows: DataFrame, others: str) -> T.StructType:
    return T.StructType([rows.schema["conv"], *(T.StructField(name, T.LongType() if kind == "long" else T.StringType()) for name, kind in (other.split() for other in others.split(", ")))])


def repaired_messages(repaired: Repair) -> DataFrame:
    """The conversations after their repair: ``conv``, ``pos``, ``place`` (order by both), ``edit`` (K, R or I), ``role``, ``text``.

    Windows of neighbouring messages are spread over all tasks, whatever conversations they belong to.
    """
    rows = _stream(repaired, whole_conversations=False)
    schema = _with_conv(rows, "pos long, place long, edit string, role string, text string")
    arrow = to_arrow_schema(schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for kind, conv, pos, fields in _replay(batches):
            if kind == _MESSAGE:
                yield from ((conv, pos, place, *message) for place, message in enumerate(fields[1]))

    return rows.mapInArrow(lambda batches: _in_batches(made(batches), arrow), schema)


def reports(repaired: Repair) -> DataFrame:
    """For each of the ``conversations``: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    The digest of a conversation needs its messages one after the other, so they pass through one task, as a stream
    that keeps one message and the letters of the audit. A conversation without messages has zeros, an empty audit and
    the digest of nothing.
    """
    rows = _stream(repaired, whole_conversations=True)
    schema = _with_conv(rows, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: _Report | None = None
        for kind, conv, _, fields in _replay(batches):
            if kind == _STUB:
                if now is not None:
                    yield now.row()
                now = _Report(conv)
            elif kind == _RUN:
                now.run(*fields)
            else:
                now.message(*fields)
        if now is not None:
            yield now.row()

    return rows.mapInArrow(lambda batches: _in_batches(summed(batches), arrow), schema)


class _Report:
    """What is counted while the runs and messages of a conversation go by."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost, self.audit = conv, dict.fromkeys("bdt", 0), 0, 0, []
        self.turns, self.first_turn, self.last_turn, self.initial = 0, None, None, None
        self.digest, self.begun = hashlib.sha256(), False

    def run(self, kinds: str, edits: str) -> None:
        for fault in "bdt":
            self.faults[fault] += kinds[1::2].count(fault)
        initials = kinds[::2] if self.initial is None else self.initial + kinds[::2]
        self.illegal += sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        self.initial = kinds[-2]
        self.audit.append(edits)
        self.cost += REROLE * edits.count("R") + DELETE * edits.count("D") + INSERT * edits.count("I")
        self.cost += TRUNCATED * sum(fault == "t" and edit[-1] != "D" for fault, edit in zip(kinds[1::2], _ONE.findall(edits), strict=True))

    def message(self, turn: int | None, made: list[tuple[str, str, str]]) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        for _, role, text in made:
            self.digest.update(f"\n{role}:{text}".encode() if self.begun else f"{role}:{text}".encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()
