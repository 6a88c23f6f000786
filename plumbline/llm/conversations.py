"""Conversations are damaged by a rule, checked for faults, and repaired at the least cost.

The repair is found in Wu-Manber-style layers: for costs 0, 1, 2 ... and each turn a bitset of the grammar's states from which the
rest can be brought to acceptance at that cost. The first layer that holds the start gives the cost, and a walk through the layers
that takes the first letter that stays inside gives the least audit.

Rows are numbered in order within ranges and cut into segments of at most SEGMENT rows, so that a conversation of any length is many
tasks' work: layers give each segment's costs from state to state, these are folded from the end, and each segment is traced for
each state that it may begin in. Only codes of a character a row meet by conversation, in streams that hold four numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: A segment's rows, as bits of a row's number.
SEGMENT_BITS = 6
#: The grammar ``(s?(ua)+)?`` as an automaton (state, initial): state; accepted states; roles of initials; letters' costs.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
LEGAL = ("su", "ua", "au")
#: Characters that are not text; ends of sentences.
BLANK, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

STATES = range(4)
#: From each state, the one role that may be inserted or put instead, as (initial, next state).
NEXT = {s: next((i, STEP[s, i]) for i in "ua" if (s, i) in STEP) for s in STATES}
#: Bit 4 * state + target: sets of states for four targets at once. INTO[letter][x]: states that a step by it takes into x.
_X = np.arange(1 << 16)
INTO = {i: sum(((_X >> 4 * to) & 15) << 4 * s for (s, own), to in STEP.items() if own == i).tolist() for i in "sua"}
INTO_ANY = [u | a for u, a in zip(INTO["u"], INTO["a"], strict=True)]
#: After the last row: what insertions to acceptance cost.
END = [0 if s in ACCEPTED else COST["I"] * (1 if NEXT[s][1] in ACCEPTED else 2) for s in STATES]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(``conv_id:turn``) % 20, nulls written as one space: 0 drops a row, 1 empties
    its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. Null roles and texts are one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, the fault of the first copy and ``at``: numbers that ascend by (conv_id, turn, role, text), nulls
    first. Equal rows stand side by side, so a group of copies is one row; ranges split a long conversation by turn and text."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("_key", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = one.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_key").alias("_text")).agg(F.min(place).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_key") == F.col("_text"))
    fault = (
        F.when(~F.col("text").rlike(BLANK), "blank")
        .when(F.col("_first.known") != F.col("turn").isNotNull(), "duplicate")
        .when(F.col("_first.turn") != F.col("turn"), "duplicate")
        .when(~F.col("text").rlike(ENDED), "truncated")
    )
    marked = one.join(first, same).select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))
    marked = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return marked.withColumn("at", F.monotonically_increasing_id())


def _segments(ordered: DataFrame) -> DataFrame:
    """(conv_id, seg, codes): a character a row: s, u, a or o (other) by role; a capital if truncated; x if it must go."""
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    rows = ordered.select("conv_id", F.shiftright("at", SEGMENT_BITS).alias("seg"), F.struct("at", code.alias("code")).alias("row"))
    rows = rows.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # at most 2 ** SEGMENT_BITS
    return rows.select("conv_id", "seg", F.array_join("rows.code", "").alias("codes"))


def _layers(codes: str, end: Callable[[int], int], wanted: int) -> list[list[int]]:
    """Layer c: for each place, the set of states from which ``end`` is reached at a cost of c at most; until ``wanted`` is in the
    first place's set. Insertions stand before rows; those after the last row are the end's."""
    n, out = len(codes), []
    nothing = [0] * (n + 1)
    back = lambda c: out[c] if c >= 0 else nothing
    while not out or out[-1][0] & wanted != wanted:
        c = len(out)
        one, two, five, six, row = back(c - 1), back(c - 2), back(c - 5), back(c - 6), [0] * (n + 1)
        row[n] = end(c)
        for i in range(n - 1, -1, -1):
            code, nxt = codes[i], i + 1
            got = one[i] | two[nxt] | INTO_ANY[five[i]]  # as before, Delete, Insert
            if code != "x":
                low = code.lower()
                keep, change = (row, one) if low == code else (five, six)
                if low != "o":
                    got |= INTO[low][keep[nxt]]
                got |= INTO_ANY[change[nxt]]
            row[i] = got
        out.append(row)
    return out


def segment_costs(codes: str) -> list[int]:
    """The least cost from each state before a segment to each state after it, row by row; -1 where there is none."""
    ends = sum(1 << 5 * s for s in STATES)
    possible = {(s, e) for s in STATES for e in STATES if e > 1 or s == e or (e == 1 and s == 0 and "s" in codes.lower())}
    layers = _layers(codes, lambda c: ends, sum(1 << 4 * s + e for s, e in possible))
    return [next(c for c, x in enumerate(layers) if x[0] >> 4 * s + e & 1) if (s, e) in possible else -1 for s in STATES for e in STATES]


def trace(codes: str, after: list[int]) -> list[tuple[int, str]]:
    """For each state before a segment, the state after it and the least of the cheapest audits, where ``after`` has the costs of all
    that follows."""
    base, n = min(after), len(codes)
    layers = _layers(codes, lambda c: sum(1 << 4 * s for s in STATES if after[s] - base <= c), sum(1 << 4 * s for s in STATES))
    holds = lambda c, i, s: c >= 0 and layers[c][i] >> 4 * s & 1
    out = []
    for start in STATES:
        c, i, s, audit = next(c for c in range(len(layers)) if holds(c, 0, start)), 0, start, []
        while i < n:
            code, low = codes[i], codes[i].lower()
            more, (_, to), kept = TRUNCATED * (code != low), NEXT[s], STEP.get((s, low))
            if holds(c - COST["D"], i + 1, s):
                letter, c, i = "D", c - COST["D"], i + 1
            elif holds(c - COST["I"], i, to):
                letter, c, s = "I", c - COST["I"], to
            elif code != "x" and kept is not None and holds(c - more, i + 1, kept):
                letter, c, i, s = "K", c - more, i + 1, kept
            else:
                letter, c, i, s = "R", c - COST["R"] - more, i + 1, to
            audit.append(letter)
        out.append((s, "".join(audit)))
    return out


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            yield from batch.slice(i, 500).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1000, most_chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row.get("text") or "")
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _stream(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Rows in, rows out, a partition's rows as one stream in their order."""
    schema = pa.schema([(c, t) for c, (_, t) in columns.items()])
    return df.mapInArrow(lambda batches: _batches(f(_rows_of(batches)), schema), ", ".join(f"`{c}` {t}" for c, (t, _) in columns.items()))


def _with_costs(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        yield r | {"costs": segment_costs(r["codes"])}


def _with_after(rows: Iterator[dict]) -> Iterator[dict]:
    """From the last segment to the first: the costs of all that follows each."""
    fresh, conv, after = True, None, END
    for r in rows:
        if fresh or r["conv_id"] != conv:
            fresh, conv, after, last = False, r["conv_id"], END, True
        yield {k: r[k] for k in ("conv_id", "seg", "codes")} | {"after": after, "last": last}
        m, last = r["costs"], False
        after = [min(m[4 * s + e] + after[e] for e in STATES if m[4 * s + e] >= 0) for s in STATES]


def _with_traces(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        found = trace(r["codes"], r["after"])
        yield {k: r[k] for k in ("conv_id", "seg", "last")} | {"ends": [s for s, _ in found], "audits": [a for _, a in found]}


def _with_choice(rows: Iterator[dict]) -> Iterator[dict]:
    """From the first segment to the last: the state that each begins in, and its audit."""
    fresh, conv, state = True, None, 0
    for r in rows:
        if fresh or r["conv_id"] != conv:
            fresh, conv, state = False, r["conv_id"], 0
        yield {k: r[k] for k in ("conv_id", "seg", "last")} | {"state": state, "audit": r["audits"][state]}
        state = r["ends"][state]


def _edited(rows: Iterator[dict]) -> Iterator[dict]:
    """Each segment's choice stands before its rows: what becomes of each, and what is inserted where."""
    letters, state, no, seg, last, conv = iter(()), 0, 0, None, False, None

    def inserted() -> dict:
        nonlocal state, no
        initial, state = NEXT[state]
        no += 1
        return {"conv_id": conv, "seg": seg, "no": no, "edit": "I", "role": ROLES[initial], "text": "", "turn": None, "was": None, "fault": None, "copies": None}

    def closing() -> Iterator[dict]:
        while last and state not in ACCEPTED:
            yield inserted()

    for r in rows:
        if r["at"] is None:
            yield from closing()
            letters, state, no, seg, last, conv = iter(r["audit"]), r["state"], 0, r["seg"], r["last"], r["conv_id"]
            continue
        while (letter := next(letters)) == "I":
            yield inserted()
        role = r["role"]
        if letter == "R":
            initial, state = NEXT[state]
            role = ROLES[initial]
        elif letter == "K":
            state = STEP[state, role[:1]]
        no += 1
        gone = letter == "D"
        yield {"conv_id": conv, "seg": seg, "no": no, "edit": letter, "role": None if gone else role, "text": None if gone else r["text"], "turn": r["turn"], "was": r["role"], "fault": r["fault"], "copies": r["copies"]}
    yield from closing()


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of rows (conv_id, turn, role, text), which may hold nulls, repeated rows and further columns: conv_id, seg and no
    (together the order), edit (``K``eep, ``R``erole, ``D``elete, ``I``nsert), role and text as repaired (null for D), turn, was (the
    role before), fault (blank, duplicate, truncated or null) and copies (equal rows side by side that this one stands for; all
    but the first are deleted as duplicates, or blank as the first is). turn, was, fault and copies are null for I.

    A null conv_id is a conversation. Rows of one turn are taken by role, then text. A role counts by its first character.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "conversations")
    key, text = dict(conversations.dtypes)["conv_id"], ("string", pa.string())
    conv = (key, conversations.select("conv_id").limit(0).toArrow().schema.field("conv_id").type)
    turn = (dict(conversations.dtypes)["turn"], conversations.select("turn").limit(0).toArrow().schema.field("turn").type)
    number, numbers, flag = ("long", pa.int64()), ("array<long>", pa.list_(pa.int64())), ("boolean", pa.bool_())
    ordered = scratch.keep(_ordered(conversations), "ordered")
    at = {"conv_id": conv, "seg": number}
    rows = _stream(_segments(ordered), _with_costs, at | {"codes": text, "costs": numbers})
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc("conv_id"), F.desc("seg"))
    rows = _stream(rows, _with_after, at | {"codes": text, "after": numbers, "last": flag}).repartition("conv_id", "seg")
    rows = _stream(rows, _with_traces, at | {"last": flag, "ends": numbers, "audits": ("array<string>", pa.list_(pa.string()))})
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    chosen = scratch.keep(_stream(rows, _with_choice, at | {"last": flag, "state": number, "audit": text}), "chosen")
    both = ordered.withColumn("seg", F.shiftright("at", SEGMENT_BITS)).unionByName(chosen, allowMissingColumns=True)
    both = both.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "at")
    return _stream(both, _edited, at | {"no": number, "edit": text, "role": text, "text": text, "turn": turn, "was": text, "fault": text, "copies": number})


def repaired(edits: DataFrame) -> DataFrame:
    """(conv_id, seg, no, role, text) of what stays, in the order of (seg, no)."""
    return edits.where("edit <> 'D'").select("conv_id", "seg", "no", "role", "text")


class _Digest:
    """One conversation's columns, row by row."""

    def __init__(self, conv):
        self.row = {"conv_id": conv} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit, self.sha, self.lines, self.before = [], hashlib.sha256(), 0, None
        self.least = self.most = None
        self.turns = 0

    def add(self, r: dict) -> None:
        row, letter = self.row, r["edit"]
        row["cost"] += COST[letter] + TRUNCATED * (r["fault"] == "truncated" and letter != "D")
        self.audit.append(letter)
        if letter != "D":
            self.sha.update(f"{chr(10) * (self.lines > 0)}{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
            self.lines += 1
        if letter == "I":
            return
        more = r["copies"] - 1
        self.audit.append("D" * more)
        row["cost"] += COST["D"] * more
        if r["fault"]:
            row[r["fault"]] += 1
        row["blank" if r["fault"] == "blank" else "duplicate"] += more
        if r["turn"] is not None:
            self.turns += r["turn"] != self.most
            self.least, self.most = r["turn"] if self.least is None else self.least, r["turn"]
        initial = r["was"][:1]
        row["illegal"] += (self.before is not None and self.before + initial not in LEGAL) + more
        self.before = initial

    def done(self) -> dict:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return self.row | {"gaps": gaps, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    held = None
    for r in rows:
        if r["edit"] is None:  # a conversation begins
            if held:
                yield held.done()
            held = _Digest(r["conv_id"])
        else:
            held.add(r)
    if held:
        yield held.done()


def digest(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """For each conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. The hash and
    the audit run through a conversation's edits in their order, as one stream that holds an audit's letters and no texts."""
    edits = edits.select("conv_id", "seg", "no", "edit", "role", "text", "turn", "was", "fault", "copies")
    first = conversations.select("conv_id").distinct().withColumn("seg", F.lit(-1).cast("long"))
    rows = edits.unionByName(first, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "seg", "no")
    conv = (dict(conversations.dtypes)["conv_id"], conversations.select("conv_id").limit(0).toArrow().schema.field("conv_id").type)
    number, text = ("long", pa.int64()), ("string", pa.string())
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return _stream(rows, _digests, {"conv_id": conv} | dict.fromkeys(names, number) | {"audit": text, "repaired_sha256": text})
