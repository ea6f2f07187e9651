"""Top-k search, conversation repair and hard negatives against brute force."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import conversation_repair as R
from notelake.llm import hard_negatives as H
from notelake.llm import pii
from notelake.llm import queries as Q
from notelake.llm import topk_search as T
from notelake.llm import vectors as V

ROWS = "vec_id long, embedding array<float>, label int, id string, key string, score int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors with ties, near copies, rows that take no part, and columns of clashing names."""
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.2, (6, 7))
    rows = []
    for k in range(900):
        v = middle[k % 6] + rng.normal(0, 0.08, 7)
        v = middle[0] + rng.normal(0, 0.001, 7) if k % 3 == 1 else v
        rows.append([k, [float(np.float32(x)) for x in v], k % 4])
    rows[200][1], rows[300][1] = list(rows[100][1]), list(rows[100][1])
    rows[5][1], rows[6][1], rows[7][1], rows[8][2], rows[9][0], rows[50][1] = None, [None] * 7, [float("nan")] + [0.0] * 6, None, None, [float("inf")] * 7
    rows[11][1] = rows[11][1][:3]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], ROWS).repartition(3)


def brute_rows(df):
    out = []
    for r in df.collect():
        if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding):
            out.append((r.vec_id, np.floor(256 * np.array(r.embedding + [0.0] * (7 - len(r.embedding)))).astype(int), r.label))
    return out


def brute_top(rows, every=50, k=5):
    for q, v, _ in rows:
        if q % every == 0:
            best = sorted((-int(v @ w), i) for i, w, _ in rows if i != q)[:k]
            yield from ((q, n, i, -s) for n, (s, i) in enumerate(best, 1))


def brute_negatives(rows):
    for a, v, label in rows:
        if a % 100 == 0:
            found = sorted((-int(v @ w), i, other) for i, w, other in rows if i != a)
            for p, i, _ in [x for x in found if x[2] == label][:5]:
                fits = [(-s, j) for s, j, other in found if other != label and 30 * -p <= 100 * -s <= 90 * -p]
                yield from ((a, i, n, j, -p, s) for n, (s, j) in enumerate(fits[:10], 1))


def small(monkeypatch):
    for name in ("BLOCK", "LEAST_GROUP", "QUERY_GROUP"):
        monkeypatch.setattr(V, name, 64)
    monkeypatch.setattr(V, "QUERY_GROUP", 5)
    monkeypatch.setattr(V, "GROUPS", 1)
    monkeypatch.setattr(V, "MOST_GROUP", 128)


def test_top_scores_equal_brute_force(vectors, monkeypatch):
    want = sorted(brute_top(brute_rows(vectors)))
    got = lambda: sorted(tuple(r) for r in T.top_scores(vectors, F.col("vec_id") % 50 == 0).collect())
    assert got() == want and len(want) == 5 * 17
    small(monkeypatch)  # many cells of several blocks
    assert got() == want


def test_lists_are_not_read_whole_where_bounds_are_sharp():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(0, 10, (4000, 8)))
    rows[:40] += 200
    query = np.floor(rows[:40].mean(axis=0))
    ids, found, read = T.Lists(np.arange(4000), rows).top(query, -1, -np.inf, 5)
    want = sorted((-int(s), i) for i, s in enumerate(rows @ query))[:5]
    assert [(-s, i) for s, i in zip(found.tolist(), ids.tolist())] == want and read < 0.7 * rows.size


def test_top_scores_of_odd_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert T.top_scores(none, F.col("vec_id") % 50 == 0).count() == 0 and H.hard_negatives(none, F.col("label"), F.col("vec_id") % 100 == 0).count() == 0
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1e30, 0.0], 2), (3, [], 2)]
    df = spark.createDataFrame([(*r, "", "", 0) for r in rows], "vec_id long, embedding array<double>, label int, id string, key string, score int")
    got = sorted(tuple(r) for r in T.top_scores(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 2, (1 << 63) - 1), (0, 2, 1, 131072), (0, 3, 1, 131072), (0, 4, 3, 0)]  # the repeated query answers once


def test_hard_negatives_equal_brute_force(vectors, monkeypatch):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in brute_rows(vectors) if label is not None]
    want = sorted(brute_negatives(rows))
    label = F.col("label").cast("long")
    got = lambda: sorted(tuple(r) for r in H.hard_negatives(vectors, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label), F.col("vec_id") % 100 == 0).collect())
    assert got() == want and len(want) > 100
    small(monkeypatch)
    monkeypatch.setattr(H, "SCORED", 7)
    assert got() == want


def test_cells_come_by_descending_bound_and_end_early():
    rng = np.random.default_rng(2)
    rows = np.floor(np.repeat(rng.normal(0, 100, (12, 6)), 50, axis=0) + rng.normal(0, 2, (600, 6)))
    books = [H.fitted(rows[:, :3]), H.fitted(rows[:, 3:])]
    index, visited, kept = H.MultiIndex(np.arange(600), rows, np.zeros(600, int), books), [], []

    def keep(ids, _, found):
        visited.extend(ids.tolist())
        kept.extend(found.tolist())

    H.SCORED, before = 1, H.SCORED
    try:
        index.visit(rows[0], keep, lambda: sorted(kept)[-5] if len(kept) >= 5 else -np.inf)
    finally:
        H.SCORED = before
    assert sorted(kept)[-5:] == sorted((rows @ rows[0]).astype(int).tolist())[-5:] and len(visited) < 300


def brute_repair(turns):
    """Costs and audits by all edit sequences, state by state (Dijkstra-free: states times turns, with whole strings)."""
    best = {"": (0, "", [])}  # initials so far -> (cost, audit, lines)

    def form(s):
        return "" if not s else s[-1]

    def allowed(state, x):
        return x == "s" and state == "" or x == "u" and state in ("", "s", "a") or x == "a" and state == "u"

    def inserted(best):
        out, todo = dict(best), list(best.items())
        while todo:
            state, (cost, audit, lines) = todo.pop()
            for x, role in (("u", "user"), ("a", "assistant")):
                if allowed(state, x) and len(audit) < 60:
                    new = (cost + 3, audit + "I", [*lines, role + ":"])
                    if x not in out or new[:2] < out[x][:2]:
                        out[x] = new
                        todo.append((x, new))
        return out

    for role, text, fault in turns:
        new = {}

        def put(state, cost, audit, lines):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, lines)

        for state, (cost, audit, lines) in inserted(best).items():
            put(state, cost + 4, audit + "D", lines)
            if fault != "gone":
                more = 3 * (fault == "cut")
                if role[:1] and allowed(state, role[:1]) and role[:1] in "sua":
                    put(role[:1], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for x, name in (("u", "user"), ("a", "assistant")):
                    if allowed(state, x):
                        put(x, cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"])
        best = new
    cost, audit, lines = min((v[:2] + (v[2],) for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_damage(rows):
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else "".join(c for c in text if c not in ".!?") if n == 2 else text
        yield from [(conv, turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)


def brute_conversations(rows):
    after = list(brute_damage(rows))
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[kind] = faults.get(kind, 0) + 1
            turns.append((role, text, {"blank": "gone", "duplicate": "gone", "truncated": "cut"}.get(kind)))
        known = {r[1] for r in own if r[1] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        yield (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *brute_repair(turns))


def talk(rng, n_conv, most):
    rows = []
    for conv in range(n_conv):
        for turn in range(rng.randrange(most)):
            text = rng.choice(["yes.", "no!", "and then", "", " \t", "ok?", "a b.", None, "long " * 50 + "."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows


@pytest.mark.parametrize("long", [4096, 4])
def test_repair_equals_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(R, "LONG", long)
    monkeypatch.setattr(R, "SEGMENT", 3)
    rows = talk(random.Random(5), 60, 14)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, _last string").repartition(3)
    got = {r.conv_id: tuple(r) for r in R.repaired(R.damaged(df)).collect()}
    want = {r[0]: r for r in brute_conversations(rows)}
    assert got == want
    assert R.repaired(R.damaged(df.limit(0))).count() == 0


def test_runs_are_advanced_by_powers():
    rng = random.Random(1)
    for _ in range(300):
        symbols = [s for _ in range(rng.randrange(6)) for s in [rng.randrange(12)] * rng.randrange(1, 9)]
        fault = {0: None, 1: "cut", 2: "gone"}
        turns = [({0: "user", 1: "assistant", 2: "system", 3: "tool"}[s // 3], str(k), fault[s % 3]) for k, s in enumerate(symbols)]
        cost, letters, tail = R.repair(R.runs_of(symbols))
        assert (cost, "".join(letters) + tail) == brute_repair(turns)[:2]
    cost, letters, tail = R.repair(((0, 100_001),))  # a long run of users: every second one becomes an answer, and one is added
    assert len(letters) == 100_001 and cost == 3 * 50_000 + 3


def test_new_queries_read_whole_tables(spark):
    rows = Q.op12_conversation_repair(spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()


def plain_field(words, field):
    """The best segmentation by the plain rule: every segment by itself, one end after another."""
    t, n = field.sequence, len(words)
    hooked = lambda i, j: any(pii._HOOK.search(w) for w in words[i:j])
    best = {(0, 0): (0.0, None)}
    for j in range(1, n + 1):
        for i in range(max(0, j - pii.LONGEST), j):
            own = field.segment @ pii.features(tuple(words[i:j]))
            for k in range(len(t)):
                if (k and hooked(i, j)) or (k == 0 and j == i + 1):
                    for a in range(len(t)):
                        if (i, a) in best:
                            v = best[i, a][0] + t[a, k] + own[k]
                            if (j, k) not in best or v > best[j, k][0]:
                                best[j, k] = (v, (i, a))
    return max(best[n, a][0] + t[a, 0] for a in range(len(t)) if (n, a) in best), best


def path_score(words, spans, field):
    t, total, last, at = field.sequence, 0.0, 0, 0
    marked = {i: (j, k) for i, j, k in spans}
    while at < len(words):
        to, k = marked.get(at, (at + 1, 0))
        total += t[last, k] + field.segment[k] @ pii.features(tuple(words[at:to]))
        at, last = to, k
    return total + t[last, 0]


def test_fast_decoding_finds_the_best_segmentation(monkeypatch):
    rng, field = random.Random(3), pii.trained()
    monkeypatch.setattr(pii, "MARGIN", -1e9)  # all that the best labelling marks
    marks = ["[at]", "(dot)", "@", "joe@x.org", "+1", "(555)", "123-4567", "10.0.0.1", "4111", "-", "..", "2024-01-05", "1[.]2", "é9", "１"]
    for _ in range(150):
        words = [rng.choice([rng.choice(marks), "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 3, 4, 12, 16]))), "".join(rng.choice("0123456789.-/()+[]x") for _ in range(rng.randrange(1, 7))), "word"]) for _ in range(rng.randrange(1, 14))]
        most, _ = plain_field(words, field)
        assert abs(path_score(words, pii.decoded(words, field), field) - most) < 1e-6


def test_added_cards_pass_their_check_and_hold_no_dates():
    find = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.Finder(pii.trained()).find(t)[1]]
    assert not [x for x in find("built 2024-01-05 12:30:45 by hand") if x[0] in ("card", "phone")]
    assert ("card", "4111.1111.1111.1111") in find("paid with 4111.1111.1111.1111 today") and not [x for x in find("paid with 4111.1111.1111.1112 today") if x[0] == "card"]
    numbers = "".join(f"{k} " for k in range(30_000))
    began = time.time()
    pii.Finder(pii.trained()).find(numbers)
    assert time.time() - began < 30  # some 170 KB of numbers: 0.1 to 0.2 s a KB before
