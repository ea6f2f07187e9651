"""Secret scans by one combined deterministic automaton.

All rule patterns become one automaton over bytes (position sets, subset construction, Moore minimisation) held in a transition
array. It reads texts from their end to their start, so where it fires a match of the rule begins; a batch of texts is scanned in one
pass over its bytes, numpy lanes stepping through the array side by side. Lanes are cut at bytes after which every state is the start
state, so cutting loses nothing. From the leftmost beginning that is free, the rule's own automaton, read forwards, walks to the last
place where it accepts: that is the span, and the next one is sought behind it. Both are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from re import _constants as C
from re import _parser as P

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import as_bytes, map_batches

#: The base rules: kind, pattern, and what a match must have (group, least length).
BASE = [
    ("assign", rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", rb"AKIA[A-Z0-9]+", 0, 16),
    ("hex", rb"[0-9a-f]+", 0, 32),
]
#: Further rules of the method.
MORE = [
    ("github", rb"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    ("google", rb"AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("stripe", rb"[rs]k_live_[A-Za-z0-9]+", 0, 24),
]
LANES = 2048
#: With so few lanes left, each is walked on its own: a numpy step costs as much as that many plain ones.
FEW_LANES = 48


class _Positions:
    """Glushkov's position sets of parsed patterns: each position has the bytes that it reads and the positions that may follow."""

    def __init__(self):
        self.reads: list[frozenset] = []
        self.follow: list[set] = []
        self.groups: dict[int, set] = {}

    def leaf(self, chars):
        self.reads.append(frozenset(chars))
        self.follow.append(set())
        return {len(self.reads) - 1}, {len(self.reads) - 1}, False

    def joined(self, parts):
        first, last, empty = set(), set(), True
        for f, l, e in parts:
            for p in last:
                self.follow[p] |= f
            first |= f if empty else set()
            last = last | l if e else l
            empty = empty and e
        return first, last, empty

    def of(self, items, fold=False):
        return self.joined([self.item(*x, fold) for x in items])

    def item(self, op, arg, fold):
        if op is C.LITERAL:
            return self.leaf({*chr(arg).lower().encode("latin-1"), *chr(arg).upper().encode("latin-1")} if fold and arg < 128 else {arg})
        if op is C.IN:
            chars = {c for kind, a in arg if kind is not C.NEGATE for c in ([a] if kind is C.LITERAL else range(a[0], a[1] + 1))}
            return self.leaf(set(range(256)) - chars if arg[0][0] is C.NEGATE else chars)
        if op is C.SUBPATTERN:
            before = len(self.reads)
            out = self.of(arg[3], bool(fold or arg[1] & re.I))
            self.groups.setdefault(arg[0], set()).update(range(before, len(self.reads)))
            return out
        if op is C.BRANCH:
            parts = [self.of(x, fold) for x in arg[1]]
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        if op is C.MAX_REPEAT:
            low, high, body = arg
            parts = [self.of(body, fold) for _ in range(max(low, 1) if high is C.MAXREPEAT else high)]
            if high is C.MAXREPEAT:
                f, l, _ = parts[-1]
                for p in l:
                    self.follow[p] |= f
            parts = [(f, l, e or k >= low) for k, (f, l, e) in enumerate(parts)]
            return self.joined(parts)
        raise ValueError(f"pattern part {op} is not supported")


def position_sets(rule) -> tuple[_Positions, set, set]:
    """(positions, first ones, last ones) of a rule. A rule that is one repetition is compiled with its least length, as shorter stretches
    are dropped anyway."""
    _, pattern, group, least = rule
    items, build = list(P.parse(pattern)), _Positions()
    if group == 0 and len(items) == 1 and items[0][0] is C.MAX_REPEAT:
        low, high, body = items[0][1]
        items[0] = (C.MAX_REPEAT, (max(low, least), high, body))
    first, last, _ = build.of(items)
    return build, first, last


def subsets(reads, follow, starts, restart: bool):
    """Subset construction: (groups of bytes, rows of next states, states as position sets). State 0 is the start; with ``restart`` a match may
    begin at every byte, else a state without positions is dead."""
    sets = sorted(set(reads), key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    groups = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    group = np.array([groups[x] for x in signature], np.int32)
    sample = [int(np.flatnonzero(group == g)[0]) for g in range(len(groups))]
    reading = [frozenset(p for p, own in enumerate(reads) if b in own) for b in sample]
    start, dead = ("start",), frozenset()
    states, order, rows = {start: 0}, [start], []
    if restart:
        states, order = {dead: 0}, [dead]
    for state in order:  # grows while it is walked
        after = starts if state == start else set().union(*(follow[p] for p in state), starts if restart else ())
        row = []
        for read in reading:
            to = frozenset(after & read)
            if to not in states:
                states[to] = len(states)
                order.append(to)
            row.append(states[to])
        rows.append(row)
    return group, np.array(rows, np.int64), order


class Walker:
    """The automaton of one rule from a fixed beginning."""

    def __init__(self, rule):
        build, first, last = position_sets(rule)
        inside = build.groups.get(rule[2], set())
        group, rows, states = subsets(build.reads, build.follow, first, restart=False)
        self.group, self.rows = group.tolist(), rows.tolist()
        self.accepts = [isinstance(s, frozenset) and bool(s & last) for s in states]
        self.dead = [s == frozenset() for s in states]
        self.within = [isinstance(s, frozenset) and bool(s & inside) for s in states]

    def span(self, data: bytes, at: int) -> tuple[int, int]:
        """(end of the longest match from ``at``, where its group begins)."""
        state, end, value = 0, at, -1
        for k in range(at, len(data)):
            state = self.rows[state][self.group[data[k]]]
            if self.dead[state]:
                break
            if value < 0 and self.within[state]:
                value = k
            if self.accepts[state]:
                end = k + 1
        return end, at if value < 0 else value


class Automaton:
    """All rules in one, read backwards: ``step[state, group[byte]]`` is the next state, ``fires[state]`` the rules (bits) of which a match
    begins at that byte; state 0 is the start."""

    def __init__(self, rules):
        self.rules = rules
        reads, before, starts, begins = [], [], set(), {}
        for k, rule in enumerate(rules):
            build, first, last = position_sets(rule)
            base = len(reads)
            reads += build.reads
            before += [set() for _ in build.reads]
            for p, follow in enumerate(build.follow):
                for q in follow:
                    before[base + q].add(base + p)
            starts |= {base + p for p in last}
            for p in first:
                begins[base + p] = begins.get(base + p, 0) | 1 << k
        self.group, step, states = subsets(reads, before, starts, restart=True)
        fires = np.array([sum({1 << k for p in s for k in range(len(rules)) if begins.get(p, 0) >> k & 1}) for s in states], np.int64)
        self.step, self.fires = self.least(step, fires)
        self.resets = np.array([bool((self.step[:, self.group[b]] == 0).all()) for b in range(256)])
        self.flat = (self.step * step.shape[1]).astype(np.int64).ravel()

    @staticmethod
    def least(step, fires):
        """Moore's minimisation: states stay together while they fire alike and step into the same classes."""
        _, part = np.unique(fires, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == part.max():
                break
            part = finer
        order = np.full(part.max() + 1, -1)
        seen = dict.fromkeys(part.tolist())
        order[list(seen)] = np.arange(len(seen))  # the start state's class is the first
        part = order[part]
        first = np.unique(part, return_index=True)[1]
        return part[step[first]], fires[first]

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which rules fire, and which; ``data`` ends with a byte that resets."""
        resets = np.flatnonzero(self.resets[data])
        nominal = np.arange(0, len(data), max(256, len(data) // LANES))
        starts = np.unique(np.concatenate([[0], resets[np.minimum(np.searchsorted(resets, nominal), len(resets) - 1)] + 1]))
        starts = starts[starts < len(data)]
        lengths = np.diff(np.append(starts, len(data)))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        group, n_groups, width = self.group[data], self.step.shape[1], lengths[0]
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(width), side="right")
        state, fires = np.zeros(len(starts), np.int64), np.repeat(self.fires, n_groups)
        at, what = [], []
        for t in range(width):
            n = active[t]
            if n <= FEW_LANES:
                break
            here = starts[:n] + t
            state[:n] = now = self.flat[state[:n] + group[here]]
            fired = fires[now]
            if fired.any():
                k = np.flatnonzero(fired)
                at.append(here[k])
                what.append(fired[k])
        if n <= FEW_LANES:
            flat, ends = self.flat.tolist(), fires.tolist()
            for k in range(n):
                now, places, rules = int(state[k]), [], []
                for place, code in enumerate(group[starts[k] + t : starts[k] + lengths[k]].tolist(), int(starts[k]) + t):
                    now = flat[now + code]
                    if ends[now]:
                        places.append(place)
                        rules.append(ends[now])
                at.append(np.array(places, np.int64))
                what.append(np.array(rules, np.int64))
        return (np.concatenate(at), np.concatenate(what)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


class Scanner:
    """Spans of every rule in texts: leftmost, non-overlapping within a rule; matches that are too short are dropped and not retried."""

    def __init__(self, rules=tuple(BASE + MORE)):
        self.rules = list(rules)
        self.automaton = Automaton(self.rules)
        self.walkers = [Walker(rule) for rule in self.rules]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule) of each text in code points, by start, then rule."""
        found: list[list] = [[] for _ in texts]
        if not texts:
            return found
        blob = b"\n" + b"\n".join(texts) + b"\n"
        at, what = self.automaton.hits(np.frombuffer(blob, np.uint8)[::-1])
        if not len(at):
            return found
        at = len(blob) - 1 - at
        order = np.argsort(at, kind="stable")
        at, what = at[order], what[order]
        begins = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
        for k, ((_, _, _, least), walker) in enumerate(zip(self.rules, self.walkers)):
            done = 0
            for start in at[what >> k & 1 == 1].tolist():
                if start >= done:
                    done, value = walker.span(blob, start)
                    if done - value >= least:
                        row = int(np.searchsorted(begins, start, side="right")) - 1
                        begin = int(begins[row])
                        found[row].append((start - begin, done - begin, k))
        for row, spans in enumerate(found):
            if spans:
                text = texts[row]
                if not text.isascii():
                    where = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    spans = [(int(np.searchsorted(where, a)), int(np.searchsorted(where, b)), k) for a, b, k in spans]
                found[row] = sorted(spans, key=lambda x: (x[0], x[2]))
        return found


@lru_cache(2)
def scanner_of(rules) -> Scanner:
    """A scanner, kept as long as the Python process."""
    return Scanner(rules)


def rendered(spans, names) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, b, k in spans)


def secret_scan(docs: DataFrame, rules=tuple(BASE + MORE), n_base: int = len(BASE)) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is an empty one. Repeated rows give repeated rows, a null doc_id stays null, other columns are not looked at.
    A span is that of the whole match, in code points.
    """

    def make():
        scanner, names = scanner_of(rules), [r[0] for r in rules]

        def f(doc_id, text):
            found = scanner.scan(as_bytes(text))
            base = [[x for x in spans if x[2] < n_base] for spans in found]
            counts = [[sum(x[2] == k for x in spans) for spans in base] for k in range(n_base)]
            return doc_id, *counts, [hashlib.sha256(rendered(x, names).encode()).hexdigest() for x in base], [rendered(x, names) for x in found]

        return f

    counted = ", ".join(f"n_{r[0]} long" for r in rules[:n_base])
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f"doc_id long, {counted}, base_sha256 string, spans string", make)
