"""Operator 11: repair of conversation structure by depth-first branch-and-bound.

A conversation's roles shall read ``(s?(ua)+)?``: perhaps a system turn, then
pairs of user and assistant. Rows are kept (cost 0), reroled to user or
assistant (3) or deleted (4; blank and repeated rows must be), empty turns are
inserted (3), and a row that stays although its text breaks off costs 3 more.
Of the cheapest repairs the one with the ASCII-least string of edit initials
(K, R, D, I) is taken; that string determines the repair.

Search (``cheapest``): nodes are (rows read, state of the pattern); an explicit
stack holds (node, cost, edits). A branch ends when its cost plus a lower bound
for the rows left exceeds the incumbent (cost, edits), or when the table of its
node has a prefix at least as good. Two prefixes of one node and cost never
begin one another, so the better prefix gives the better whole string.

Spark: rows are range-partitioned by conversation and turn, so that one huge
conversation is spread over tasks. Each task cuts its conversations into
segments of at most ``SEGMENT`` rows. A conversation that is one segment is
finished there. For the others every segment is solved from each state to each
state; a second step folds these tables, a few bytes a row, in order, and the
segments' texts are repaired by the edits found, each segment in its own task.
Only the hash of a whole conversation reads its repaired segments one after the
other, as a stream.

Nulls are one space in role and text and in the hash key; null turns come first
and count in no gap; rows of one turn are taken by role and text; null conv_ids
are one conversation. A role whose first letter is none of s, u, a (also the
empty one) must be reroled or deleted. A conversation without rows has an empty
repair. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from media_forecast.llm.common import stored
from media_forecast.shipping import ship_package

SEGMENT = 64  # rows in one search
SEGMENT_BYTES = 4 << 20  # a segment ends early when its texts reach this
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3
GONE, FINE, BLANK, DUPLICATE, TRUNCATED = -1, 0, 1, 2, 3
_BLANKS = "\\x20\\x09-\\x0D"

# States of the pattern: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPT = frozenset((START, ASSISTANT))


def following(state: int) -> int:
    """The state after the turn of user or assistant that the pattern wants next."""
    return ASSISTANT if state == USER else USER


def kept(letter: str, state: int) -> int | None:
    """The state after a row of this role is kept, None if it may not stand here."""
    if letter == "s":
        return SYSTEM if state == START else None
    if letter == "u":
        return USER if state != USER else None
    return ASSISTANT if letter == "a" and state == USER else None


def edits_of(symbol: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, state after) of all that may be done with a row. Symbols: role s, u, a, x (other); capitals break off; - must go."""
    found = [(DELETE, "D", state)]
    if symbol != "-":
        broken = BROKEN * symbol.isupper()
        found.append((broken + REROLE, "R", following(state)))
        if (after := kept(symbol.lower(), state)) is not None:
            found.append((broken, "K", after))
    return found


def lower_bounds(symbols: str, goals: frozenset[int]) -> list[list[float]]:
    """For each number of rows read and each state, a lower bound of what the rest costs, whatever the edits' letters.

    Bounds that look at single rows or pairs leave so much room that the search
    grows exponentially on conversations of broken turns; these follow the pattern.
    """
    low = [[float("inf")] * len(STATES) for _ in range(len(symbols) + 1)]
    low[-1] = [0.0 if state in goals else float("inf") for state in STATES]
    for k in range(len(symbols), -1, -1):
        if k < len(symbols):
            low[k] = [min(cost + low[k + 1][after] for cost, _, after in edits_of(symbols[k], state)) for state in STATES]
        for _ in STATES:  # inserted turns lead on without reading a row
            low[k] = [min(low[k][state], INSERT + low[k][following(state)]) for state in STATES]
    return low


@lru_cache(maxsize=20_000)
def cheapest(symbols: str, start: int, goals: frozenset[int]) -> tuple[int, str] | None:
    """The cheapest (cost, edits) from ``start`` over all rows to one of ``goals``; None if there is none."""
    low, n = lower_bounds(symbols, goals), len(symbols)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        k, state, cost, edits = stack.pop()
        least = cost + low[k][state]
        if least == float("inf") or best is not None and (least > best[0] or least == best[0] and edits > best[1][: len(edits)]):
            continue
        before = seen.get((k, state))
        if before is not None and before <= (cost, edits):
            continue
        seen[k, state] = (cost, edits)
        if k == n and state in goals and (best is None or (cost, edits) < best):
            best = (cost, edits)
        branches = [(cost + INSERT, edits + "I", k, following(state))]
        if k < n:
            branches += [(cost + more, edits + edit, k + 1, after) for more, edit, after in edits_of(symbols[k], state)]
        # The most promising branch is taken first.
        branches.sort(key=lambda b: (b[0] + low[b[2]][b[3]], b[1]), reverse=True)
        stack.extend((k2, state2, cost2, edits2) for cost2, edits2, k2, state2 in branches)
    return best


def ways(symbols: str) -> list[tuple[int, str] | None]:
    """The cheapest edits of a segment from each state to each state, by 4 * from + to."""
    return [cheapest(symbols, a, frozenset((b,))) for a in STATES for b in STATES]


class Repair:
    """Applies edits to rows, piece by piece."""

    def __init__(self):
        self.pairs = 0  # turns of user or assistant so far

    def lines(self, edits: str, roles: list[str], texts: list[str]) -> list[str]:
        out, row = [], 0
        for edit in edits:
            role, text = ("user", "assistant")[self.pairs % 2], ""
            if edit != "I":
                text = texts[row]
                if edit == "K":
                    role = roles[row]
                row += 1
            if edit != "D":
                out.append(f"{role}:{text}")
                self.pairs += edit != "K" or not role.startswith("s")
        return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after the damage; dropped ones stay as marks of their conversation."""
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    rows = rows.withColumn("hit", hit)
    text = F.when(F.col("hit") < 2, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 0, "").when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, gone)`` with the first fault of each."""
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    text = F.col("text")
    fault = (
        F.when(F.col("gone"), GONE).when(~text.rlike(f"[^{_BLANKS}]"), BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE).when(~text.rlike(f"[.!?][{_BLANKS}]*\\z"), TRUNCATED).otherwise(FINE)
    )
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))


class Segment:
    """Consecutive rows of one conversation, in order."""

    def __init__(self):
        self.roles, self.texts, self.symbols, self.size = [], [], "", 0
        self.faults = [0, 0, 0, 0]
        self.illegal, self.turns, self.first_turn, self.last_turn = 0, 0, None, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault == GONE:
            return
        initial = role[:1]
        if self.roles:
            self.illegal += self.roles[-1][:1] + initial not in ("su", "ua", "au")
        letter = initial if initial in ("s", "u", "a") else "x"
        self.symbols += "-" if fault in (BLANK, DUPLICATE) else letter.upper() if fault == TRUNCATED else letter
        self.faults[fault] += 1
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT or self.size >= SEGMENT_BYTES


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SEGMENTS = (
    "conv_id long, part int, seg int, whole boolean, " + RESULT
    + ", symbols string, turns long, first_turn long, last_turn long, first string, last string,"
    " costs array<int>, edits array<string>, roles array<string>, texts array<string>"
)
_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _types(schema: str) -> dict[str, pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
             "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return {name: known[kind] for name, kind in (field.split() for field in schema.split(","))}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    types = _types(schema)
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], list(types))


def sha256(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def span(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def finished(s: Segment) -> dict:
    """The results of a conversation that is one segment."""
    cost, edits = cheapest(s.symbols, START, ACCEPT)
    return {
        "gaps": span(s.first_turn, s.last_turn, s.turns), "blank": s.faults[BLANK], "duplicate": s.faults[DUPLICATE],
        "truncated": s.faults[TRUNCATED], "illegal": s.illegal, "cost": cost, "audit": edits,
        "repaired_sha256": sha256(Repair().lines(edits, s.roles, s.texts)),
    }


def unfinished(s: Segment) -> dict:
    found = ways(s.symbols)
    return {
        "blank": s.faults[BLANK], "duplicate": s.faults[DUPLICATE], "truncated": s.faults[TRUNCATED], "illegal": s.illegal,
        "symbols": s.symbols, "turns": s.turns, "first_turn": s.first_turn, "last_turn": s.last_turn,
        "first": s.roles[0][:1] if s.roles else None, "last": s.roles[-1][:1] if s.roles else None,
        "costs": [w and w[0] for w in found], "edits": [w and w[1] for w in found], "roles": s.roles, "texts": s.texts,
    }


def segments(ordered: DataFrame) -> DataFrame:
    """Segments of rows that come sorted by conversation; those of whole conversations are finished."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size = TaskContext.get().partitionId(), [], 0
        seg = -1
        # The segments of the conversation being read; it is cut if it may go on in another task.
        conv, open_segments, cut = None, [], True

        def closed(cut):
            nonlocal seg
            whole = len(open_segments) == 1 and not cut
            for s in open_segments:
                seg += 1
                yield {"conv_id": conv, "part": part, "seg": seg, "whole": whole, **(finished(s) if whole else unfinished(s))}

        def emit(cut):
            nonlocal out, size
            for row in closed(cut):
                out.append(row)
                size += 200 + sum(map(len, row.get("texts") or ()))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
            for conv_id, turn, role, text, fault in zip(*columns, strict=True):
                if open_segments and conv_id != conv:
                    emit(cut)
                    open_segments, cut = [], False
                conv = conv_id
                if not open_segments:
                    open_segments.append(Segment())
                elif open_segments[-1].full():
                    if len(open_segments) == 2:  # a long conversation leaves its segments as they fill
                        last = open_segments.pop()
                        emit(True)
                        open_segments, cut = [last], True
                    open_segments.append(Segment())
                open_segments[-1].add(turn, role, text, fault)
            if size >= SEGMENT_BYTES or len(out) >= 1000:
                yield _batch(out, SEGMENTS)
                out, size = [], 0
        if open_segments:
            emit(True)
        if out:
            yield _batch(out, SEGMENTS)

    return ordered.mapInArrow(run, SEGMENTS)


class Fold:
    """Joins the segments of one conversation in their order."""

    def __init__(self, conv_id: int | None):
        self.total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.conv_id, self.turns, self.first_turn, self.last_turn, self.last = conv_id, 0, None, None, None
        self.settled: list[str] = []  # edits that all states share
        self.reach: dict[int, tuple[int, str]] = {START: (0, "")}
        self.pieces: list[tuple[int, int, str]] = []  # part, seg, symbols

    def add(self, r: dict) -> None:
        for name in self.total:
            self.total[name] += r[name]
        if r["first"] is not None:
            if self.last is not None:
                self.total["illegal"] += self.last + r["first"] not in ("su", "ua", "au")
            self.last = r["last"]
        if r["first_turn"] is not None:
            self.turns += r["turns"] - (r["first_turn"] == self.last_turn)
            self.first_turn = r["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = r["last_turn"]
        self.pieces.append((r["part"], r["seg"], r["symbols"]))
        reach: dict[int, tuple[int, str]] = {}
        for a, (cost, edits) in self.reach.items():
            for b in STATES:
                more = r["costs"][4 * a + b]
                if more is not None:
                    way = (cost + more, edits + r["edits"][4 * a + b])
                    if b not in reach or way < reach[b]:
                        reach[b] = way
        shared = commonprefix([edits for _, edits in reach.values()])
        self.settled.append(shared)
        self.reach = {b: (cost, edits[len(shared):]) for b, (cost, edits) in reach.items()}

    def rows(self) -> Iterator[dict]:
        cost, tail = min(way for state, way in self.reach.items() if state in ACCEPT)
        audit = "".join(self.settled) + tail
        at = pairs = 0
        for k, (part, seg, symbols) in enumerate(self.pieces):
            begin, before, row = at, pairs, 0
            while at < len(audit) and (row < len(symbols) or k == len(self.pieces) - 1):
                edit = audit[at]
                pairs += edit in "IR" or edit == "K" and symbols[row].lower() != "s"
                row += edit != "I"
                at += 1
            out = {"conv_id": self.conv_id, "part": part, "seg": seg, "piece": audit[begin:at], "before": before, "place": k}
            if k == len(self.pieces) - 1:
                out |= self.total | {"gaps": span(self.first_turn, self.last_turn, self.turns), "cost": cost, "audit": audit}
            yield out


FOLDED = "conv_id long, part int, seg int, place long, piece string, before long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
HASHED = "conv_id long, repaired_sha256 string"


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(first of its conversation, row) of rows sorted by conversation."""
    conv, begun = None, False
    for batch in batches:
        for row in batch.to_pylist():
            yield not begun or row["conv_id"] != conv, row
            conv, begun = row["conv_id"], True


def folded(parts: DataFrame) -> DataFrame:
    """Edits of each segment, and on the last one the results of the conversation."""

    def run(batches):
        fold, out = None, []
        for fresh, row in grouped(batches):
            if fresh:
                if fold is not None:
                    out.extend(fold.rows())
                fold = Fold(row["conv_id"])
            fold.add(row)
            if len(out) >= 1000:
                yield _batch(out, FOLDED)
                out = []
        if fold is not None:
            out.extend(fold.rows())
        if out:
            yield _batch(out, FOLDED)

    by_conv = parts.drop("roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return by_conv.mapInArrow(run, FOLDED)


def hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from the conversations' repaired segments, read as a stream in their order."""

    def run(batches):
        digest, any_line, conv = None, False, None
        for fresh, row in grouped(batches):
            if fresh:
                if digest is not None:
                    yield _batch([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], HASHED)
                digest, any_line, conv = hashlib.sha256(), False, row["conv_id"]
            if row["lines"] is not None:
                digest.update(("\n" * any_line + row["lines"]).encode())
                any_line = True
        if digest is not None:
            yield _batch([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], HASHED)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, HASHED)


def repaired_segments(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, place, lines): the repaired rows of each segment; null without rows."""
    schema = "conv_id long, place long, lines string"

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                repair = Repair()
                repair.pairs = r["before"]
                lines = repair.lines(r["piece"], r["roles"], r["texts"])
                out.append({"conv_id": r["conv_id"], "place": r["place"], "lines": "\n".join(lines) if lines else None})
            yield _batch(out, schema)

    both = parts.select("part", "seg", "roles", "texts").join(edits.select("conv_id", "part", "seg", "place", "piece", "before"), ["part", "seg"])
    return both.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text, fault)``: faults counted, cheapest repair, its hash."""
    ship_package(rows.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE]  # a row before its copies
    found = stored(segments(rows.repartitionByRange(*order).sortWithinPartitions(*order)), "segments")
    names = ["conv_id", *(f.split()[0] for f in RESULT.split(", "))]
    whole, parts = found.where("whole").select(*names), found.where("NOT whole")
    edits = stored(folded(parts), "edits")
    hashed = hashes(repaired_segments(parts, edits))
    results = edits.where("cost IS NOT NULL").alias("e").join(hashed.alias("h"), F.col("e.conv_id").eqNullSafe(F.col("h.conv_id")))
    return whole.unionAll(results.select("e.conv_id", *_LONGS, "audit", "repaired_sha256"))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The contract's row per conversation."""
    return repair(faults(damaged(conversations)))
