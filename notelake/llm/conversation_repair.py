"""Conversation structure repair: the cheapest edits after which roles read as an optional system turn, then user and assistant in turn.

A turn is one of twelve symbols (role u, a, s or other; sound, truncated or to be deleted). Equal consecutive symbols are one run. What a turn
costs between the four states of the form (nothing yet, after system, after user, after assistant) is a 4 x 4 matrix under minimum and sum; a run
of n turns is advanced by the matrix's binary powers, which are cached. Going back from the end gives the cost to go; going forward,
the least letter among the cheapest edits is taken at each turn, and halves of runs are unrolled from the cache too.

Ordinary conversations are repaired whole, one after another in a stream. A long one (over LONG turns or LONG_CHARS characters) is cut into
segments: each gives its matrix, costs to go come back over the segments, states go forward over them, and each is unrolled by itself, so
one conversation may hold most of the table. Only its SHA-256, which has no parts, is made by one task, that reads the lines in order
and holds one batch.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import written
from notelake.operators.ranks import ranked

#: Costs of the edits, and what a truncated turn that stays adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
LONG, LONG_CHARS, SEGMENT = 4096, 4 << 20, 16_384
BLANKS = " \t\n\v\f\r"
FAR = 1 << 60
#: The state after an inserted or reroled turn, and the roles by states.
NEXT, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
LAST = (0, 6, 3, 0)  # what is still to be inserted at the end, by state
CLASSES, SOUND, CUT, GONE = "uas", 0, 1, 2
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def keeps(symbol: int, state: int) -> int | None:
    """The state after a kept turn, if it may be kept."""
    role, fault = divmod(symbol, 3)
    if fault == GONE:
        return None
    if role == 0:
        return 2 if state != 2 else None
    return 3 if role == 1 and state == 2 else 1 if role == 2 and state == 0 else None


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that use up a turn."""
    fault = symbol % 3
    more = TRUNCATED if fault == CUT else 0
    out = [("D", DELETE, state)]
    if (kept := keeps(symbol, state)) is not None:
        out.append(("K", more, kept))
    return out if fault == GONE else [*out, ("R", REROLE + more, NEXT[state])]


def product(a, b):
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@lru_cache(None)
def power(symbol: int, k: int):
    """The matrix of 2**k turns of one symbol."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    rows = []
    for start in range(4):
        row, state, cost = [FAR] * 4, start, 0
        for _ in range(3):  # more than two inserted turns come back to a state that was cheaper
            for _, own, to in options(symbol, state):
                row[to] = min(row[to], cost + own)
            state, cost = NEXT[state], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def back(symbol: int, n: int, go: tuple) -> tuple:
    """Costs to go before a run, from those after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            m = power(symbol, k)
            go = tuple(min(m[i][j] + go[j] for j in range(4)) for i in range(4))
    return go


@lru_cache(1 << 16)
def unrolled(symbol: int, n: int, state: int, go: tuple) -> tuple[int, tuple[str, ...]]:
    """(state after the run, letters of each turn) of the cheapest edits of least letters."""
    if n > 1:
        first = 1 << (n - 1).bit_length() - 1
        middle = plain(back(symbol, n - first, go))
        state, head = unrolled(symbol, first, state, middle)
        state, tail = unrolled(symbol, n - first, state, go)
        return state, head + tail
    before, letters = back(symbol, 1, go), ""
    while True:
        goal = before[state]
        fits = [(x, to) for x, cost, to in options(symbol, state) if cost + go[to] == goal]
        if INSERT + before[NEXT[state]] == goal:
            fits.append(("I", NEXT[state]))
        letter, state = min(fits)
        letters += letter
        if letter != "I":
            return state, (letters,)


def plain(go: tuple) -> tuple:
    """The same costs to go above their least, so that equal shapes are found again."""
    return tuple(x - min(go) for x in go)


def runs_of(symbols) -> tuple[tuple[int, int], ...]:
    return tuple((s, sum(1 for _ in own)) for s, own in groupby(symbols))


def segment_matrix(runs):
    """The matrix of a sequence of runs."""
    out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for symbol, n in runs:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = product(out, power(symbol, k))
    return out


def unroll(runs, state: int, go: tuple) -> tuple[int, list[str]]:
    """(state at the end, letters of each turn) of a sequence of runs, from a state and the costs to go after it."""
    after = [go]
    for symbol, n in reversed(runs):
        after.append(back(symbol, n, after[-1]))
    letters: list[str] = []
    for (symbol, n), own in zip(runs, after[-2::-1]):
        state, more = unrolled(symbol, n, state, plain(own))
        letters.extend(more)
    return state, letters


@lru_cache(1 << 14)
def repair(runs) -> tuple[int, tuple[str, ...], str]:
    """(cost, letters of each turn, letters after the last) of a whole conversation."""
    go = LAST
    for symbol, n in reversed(runs):
        go = back(symbol, n, go)
    state, letters = unroll(runs, 0, LAST)
    return go[0], tuple(letters), ending(state)


def ending(state: int) -> str:
    return "I" * (LAST[state] // INSERT)


def edited(state: int, letters: str, role: str, text: str) -> tuple[int, list[str]]:
    """(state, lines) after the edits at one turn."""
    lines, symbol = [], symbol_of(role, SOUND)
    for x in letters:
        if x == "I":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:")
        elif x == "R":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:{text}")
        elif x == "K":
            state = keeps(symbol, state)
            lines.append(f"{role}:{text}")
    return state, lines


def symbol_of(role: str, fault: int) -> int:
    return 3 * (CLASSES.index(role[:1]) if role[:1] and role[:1] in CLASSES else 3) + fault


def is_illegal(a: int, b: int) -> bool:
    """Of the classes of two adjacent turns."""
    return (a, b) not in ((2, 0), (0, 1), (1, 0))


def _whole(conv, turns: list[tuple]) -> tuple:
    """The result of one conversation of (turn, role, text, last character that is no blank)."""
    seen, symbols, faults = set(), [], [0, 0, 0]
    for _, role, text, last in turns:
        fault = SOUND
        if not last:
            fault, faults[0] = GONE, faults[0] + 1
        elif (role, text) in seen:
            fault, faults[1] = GONE, faults[1] + 1
        elif last not in ".!?":
            fault, faults[2] = CUT, faults[2] + 1
        seen.add((role, text))
        symbols.append(symbol_of(role, fault))
    known = {t for t, *_ in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(is_illegal(a // 3, b // 3) for a, b in zip(symbols, symbols[1:]))
    cost, letters, tail = repair(runs_of(symbols))
    digest, state, first = hashlib.sha256(), 0, True
    for (_, role, text, _), own in [*zip(turns, letters), ((None, "", "", ""), tail)]:
        state, lines = edited(state, own, role, text)
        for line in lines:
            digest.update(("" if first else "\n").encode() + line.encode())
            first = False
    return conv, min(gaps, (1 << 63) - 1), *faults, illegal, cost, "".join(letters) + tail, digest.hexdigest()


def _stream(batches):
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    now, turns, begun, out = None, [], False, []
    for batch in batches:
        for conv, turn, role, text, last, dropped in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "_last", "dropped"))):
            if begun and conv != now:
                out.append(_whole(now, turns))
                turns = []
            now, begun = conv, True
            if not dropped:
                turns.append((turn, role, text, last))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in names[-2:] else pa.int64()) for n, c in zip(names, zip(*out))], names=names)
            out = []
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if n in names[-2:] else pa.int64()) for n, x in zip(names, _whole(now, turns))], names=names)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) of a table of turns, damaged by crc32(``conv_id:turn``) % 20; nulls of role, text and in the key are one space.
    0 drops a turn (the row stays, marked), 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes it a user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).when(kind != 0, F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n", "_k")


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("_head"), F.asc("_hash")]


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of (conv_id, turn, role, text, dropped): one row for each
    conv_id that is there.

    Turns are taken by turn (nulls first), then role, the text's first 256 characters and its hash; dropped ones only name their
    conversation. A turn's first fault counts: blank, duplicate of an earlier one (role and text), truncated. Turns without conv_id are one
    conversation. Null roles and texts are one space; a role's first character decides what it is, so an unknown or empty one can't be kept. A
    conversation without turns gives zeros, an empty audit and the hash of an empty text; an empty table gives no rows. Gaps that pass the ends of a long count as
    its end. Columns of other names aren't looked at.
    """
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    rows = rows.withColumns({"_c": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "_last": F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)})
    rows = rows.withColumns({"_head": F.substring("text", 1, 256), "_hash": F.xxhash64("text")})
    sizes = rows.groupBy("_c").agg(F.count(F.when(~F.col("dropped"), 1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long = sizes.filter((F.col("n") > LONG) | (F.col("chars") > LONG_CHARS)).select("_c")
    if long.isEmpty():
        return _ordinary(rows)
    long = written(long)
    return _ordinary(rows.join(long, "_c", "left_anti")).unionByName(_in_segments(rows.filter("NOT dropped").join(long, "_c", "left_semi")))


def _ordinary(rows: DataFrame) -> DataFrame:
    own = rows.repartition("_c").sortWithinPartitions("_c", *_order())
    return own.select("conv_id", "turn", "role", "text", "_last", "dropped").mapInArrow(_stream, RESULT)


def _in_segments(rows: DataFrame) -> DataFrame:
    """The result of long conversations."""
    placed = ranked(rows, ["_c"], _order(), "_pos").withColumn("_key", F.sha2(F.concat("role", F.lit("\x00"), "text"), 256))
    first = placed.groupBy("_c", "_key").agg(F.min("_pos").alias("_first"))
    again = F.col("_pos") > F.col("_first")
    blank, cut = F.col("_last") == "", ~F.col("_last").isin(".", "!", "?")
    role = F.coalesce(F.nullif(F.instr(F.lit(CLASSES), F.nullif(F.substring("role", 1, 1), F.lit(""))), F.lit(0)), F.lit(4)) - 1
    fault = F.when(blank | again, GONE).when(cut, CUT).otherwise(SOUND)
    kind = F.when(blank, "blank").when(again, "duplicate").when(cut, "truncated")
    placed = placed.join(first, ["_c", "_key"]).select("_c", "conv_id", "turn", "role", "text", (F.col("_pos") - 1).alias("_pos"), (role * 3 + fault).cast("int").alias("_symbol"), kind.alias("_kind"))
    placed = written(placed)
    segments = placed.groupBy("_c", F.floor(F.col("_pos") / SEGMENT).alias("seg")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_symbol"))), lambda x: x["_symbol"]).alias("symbols"))
    segments = written(segments)  # at most SEGMENT numbers a row

    def matrices(frames):
        for f in frames:
            out = [(c, g, [x for row in segment_matrix(runs_of(s)) for x in row], sum(is_illegal(a // 3, b // 3) for a, b in zip(s, s[1:])), s[0] // 3, s[-1] // 3) for c, g, s in zip(f["_c"], f["seg"], f["symbols"].map(list))]
            yield pd.DataFrame(out, columns=["_c", "seg", "matrix", "illegal", "first", "last"])

    def costs(frame):
        """What is to go after each segment of a conversation: a row a segment, never the turns."""
        frame, go, out = frame.sort_values("seg"), LAST, []
        for m in frame["matrix"].tolist()[::-1]:
            out.append(list(go))
            go = tuple(min(int(m[4 * i + j]) + go[j] for j in range(4)) for i in range(4))
        between = sum(map(is_illegal, frame["last"].tolist()[:-1], frame["first"].tolist()[1:]))
        return pd.DataFrame({"_c": frame["_c"], "seg": frame["seg"], "go": out[::-1], "cost": go[0], "illegal": int(frame["illegal"].sum()) + between})

    def ends(frames):
        for f in frames:
            yield pd.DataFrame([(c, g, [unroll(runs_of(s), k, tuple(map(int, go)))[0] for k in range(4)]) for c, g, s, go in zip(f["_c"], f["seg"], f["symbols"].map(list), f["go"])], columns=["_c", "seg", "ends"])

    def begins(frame):
        frame, state, out = frame.sort_values("seg"), 0, []
        for e in frame["ends"]:
            out.append(state)
            state = int(e[state])
        return pd.DataFrame({"_c": frame["_c"], "seg": frame["seg"], "state": out, "tail": [""] * (len(out) - 1) + [ending(state)]})

    def letters(frames):
        for f in frames:
            out = []
            for c, g, s, go, state, tail in zip(f["_c"], f["seg"], f["symbols"].map(list), f["go"], f["state"], f["tail"]):
                _, own = unroll(runs_of(s), int(state), tuple(map(int, go)))
                states, at = [], int(state)
                for symbol, x in zip(s, own):
                    states.append(at)
                    for y in x:
                        at = at if y == "D" else keeps(symbol, at) if y == "K" else NEXT[at]
                out.append((c, g, own, states, at, tail))
            yield pd.DataFrame(out, columns=["_c", "seg", "letters", "states", "end", "tail"])

    go = written(segments.select("_c", "seg", "symbols").mapInPandas(matrices, "_c string, seg long, matrix array<long>, illegal long, first int, last int").groupBy("_c").applyInPandas(costs, "_c string, seg long, go array<long>, cost long, illegal long"))
    both = segments.join(go, ["_c", "seg"])
    begun = both.select("_c", "seg", "symbols", "go").mapInPandas(ends, "_c string, seg long, ends array<int>").groupBy("_c").applyInPandas(begins, "_c string, seg long, state int, tail string")
    plan = written(both.join(begun, ["_c", "seg"]).select("_c", "seg", "symbols", "go", "state", "tail").mapInPandas(letters, "_c string, seg long, letters array<string>, states array<int>, end int, tail string"))
    audit = plan.groupBy("_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.concat(F.array_join("letters", ""), "tail").alias("t")))), lambda x: x["t"]), "").alias("audit"))
    each = plan.select("_c", (F.col("seg") * SEGMENT).alias("_base"), F.posexplode(F.arrays_zip("letters", "states")).alias("_k", "x")).select("_c", (F.col("_base") + F.col("_k")).alias("_pos"), "x.letters", F.col("x.states").alias("state"))
    tails = plan.filter("tail <> ''").select("_c", F.lit((1 << 62)).alias("_pos"), F.col("tail").alias("letters"), F.col("end").alias("state"), F.lit("").alias("role"), F.lit("").alias("text"))
    lines = placed.select("_c", "_pos", "role", "text").join(each, ["_c", "_pos"]).unionByName(tails).filter("letters <> 'D'")

    def digests(batches):
        now, digest, first = None, None, True
        for batch in batches:
            for c, role, text, own, state in zip(*(batch.column(x).to_pylist() for x in ("_c", "role", "text", "letters", "state"))):
                if c != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["_c", "repaired_sha256"])
                    now, digest, first = c, hashlib.sha256(), True
                for line in edited(state, own, role, text)[1]:
                    digest.update(("" if first else "\n").encode() + line.encode())
                    first = False
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["_c", "repaired_sha256"])

    hashes = lines.repartition("_c").sortWithinPartitions("_c", "_pos").select("_c", "role", "text", "letters", "state").mapInArrow(digests, "_c string, repaired_sha256 string")
    count = lambda x: F.count(F.when(F.col("_kind") == x, 1)).alias(x)
    span = F.max("turn").cast("decimal(38)") - F.min("turn").cast("decimal(38)") + 1 - F.count_distinct("turn")
    facts = placed.groupBy("_c").agg(F.first("conv_id").alias("conv_id"), F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    facts = facts.join(go.filter("seg = 0").select("_c", "illegal", "cost"), "_c").join(audit, "_c").join(hashes, "_c", "left")
    none = hashlib.sha256().hexdigest()
    return facts.select(*(F.col(x.split(" ")[0]) for x in RESULT.split(", ")[:-1]), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
