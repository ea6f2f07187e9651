"""Personal data by fixed patterns and a semi-Markov conditional random field.

Sarawagi and Cohen, "Semi-Markov Conditional Random Fields for Information Extraction" (2004): a label covers a whole segment, so
features look at whole spans (its digits, separators, checks), and each label depends on the one before it. Dynamic programming over
segments of at most ``LONGEST`` words chooses boundaries and kinds jointly. An entity holds a word with a digit, an ``@`` or a spelt-out ``at`` (in any case), a hook. No
segment reaches further than LONGEST - 1 words from its hook; the words beyond are outside whatever the labels, as are the places before
and after a text. So the windows of that reach, with "outside" on both sides, are decoded on their own, with the whole text's result.

The patterns' spans always stay; the field adds spans that overlap none of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import as_bytes, map_batches

KINDS = ("email", "ip", "card", "phone")
#: Words at most in a segment, and examples and rounds of the training.
LONGEST, EXAMPLES, ROUNDS = 9, 240, 40
#: The score by which the best labelling must beat the one without the span.
MARGIN = 2.0
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9][0-9 .-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match never starts within digits; saying so keeps long ones linear
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, non-overlapping within a kind; failing matches are dropped."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        to = at + 1
        if start < at and (m := _DOMAIN.match(text, to)):
            found.append((0, start, m.end()))
            done = to = m.end()
        at = text.find("@", to)
    for run in _DIGITS.finditer(text):
        low, high = run.span()
        if high - low >= 7:
            found += [(1, m.start(), m.end()) for m in _IP.finditer(text, low, high) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
            if high - low >= 13:
                found += [(2, m.start(), m.end()) for m in _CARD.finditer(text, low, high) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(found)


# The random field: label 0 is "outside" and covers one word, label k is KINDS[k - 1].
_WORD = re.compile(r"[^\s]+")
_HOOK = re.compile(r"[0-9@]|[\[(<{]at[\])>}]", re.I)
_AT, _DOT = re.compile(r"^[\[(<{](?:at)[\])>}]$", re.I), re.compile(r"^[\[(<{](?:dot)[\])>}]$", re.I)
_PIECE = re.compile(r"^[A-Za-z0-9._%+-]+$")
_N_FEATURES = 16


@lru_cache(1 << 14)
def features(words: tuple[str, ...]) -> np.ndarray:
    """Features of a candidate segment as a whole."""
    joint = " ".join(words)
    d = only_digits(joint)
    letters = sum(c.isalpha() for c in joint)
    groups = re.findall(r"[0-9]+", joint)
    spelt_at, spelt_dot = sum(bool(_AT.match(w)) for w in words), sum(bool(_DOT.match(w)) for w in words)
    spelt = len(words) >= 5 and len(words) % 2 == 1 and all(bool((_AT if k == 1 else _DOT if k % 2 else _PIECE).match(w)) for k, w in enumerate(words))
    return np.array([
        1.0,
        len(words) == 1,
        (len(words) - 1) / LONGEST,
        not d,
        bool(d) and not letters,
        9 <= len(d) <= 12 and not letters,
        13 <= len(d) <= 19 and not letters,
        13 <= len(d) <= 19 and not letters and luhn(d),
        joint[0] in "+(" and len(d) >= 9 and not letters,
        bool(re.search(r"[0-9][)./ -]+[0-9]", joint)) and not letters,
        len(groups) == 4 and not letters and all(len(g) <= 3 and int(g) <= 255 for g in groups) and joint.count(".") + joint.lower().count("[.]") >= 3,
        "@" in joint and "." in joint.split("@")[-1],
        spelt,
        spelt_at + spelt_dot > 0 and not spelt,
        3 <= len(groups) <= 5 and 10 <= len(d) <= 12 and not letters and all(2 <= len(g) <= 4 for g in groups),
        letters > 0 and bool(d),
    ], float)


def _invented(seed: int):
    """Training lines made by rule: entities in several spellings among plain words and numbers that are none."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeiounrstlhd"), rng.integers(2, 8)))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        d = digits(15)
        return d + next(str(c) for c in range(10) if luhn(d + str(c)))

    def entity(kind):
        form = rng.integers(0, 3)
        if kind == 0:
            a, b, c, d = word(), word(), word(), word()
            two, three = [a, "[at]", b, "[dot]", c, "[dot]", d], [a, "(at)", b, "(dot)", c, "(dot)", d, "(dot)", "com"]
            return [[f"{a}@{b}.{c}"], [a, "[at]", b, "[dot]", c], [f"{a}.{b}", "(at)", c, "(dot)", "com"], two, three][rng.integers(0, 5)]
        if kind == 1:
            parts = [str(x) for x in rng.integers(0, 256, 4)]
            return [[".".join(parts)], ["[.]".join(parts)], [".".join(parts)]][form]
        if kind == 2:
            c = card()
            return [[c], [c[k : k + 4] for k in range(0, 16, 4)], [".".join(c[k : k + 4] for k in range(0, 16, 4))]][form]
        a, b, c = digits(3), digits(3), digits(4)
        return [["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [a, b, c]][form]

    def other():
        form = rng.integers(0, 7)
        return [[digits(4)], [digits(2), word()], [f"{digits(1)}.{digits(1)}.{digits(2)}"], [digits(12)], [digits(16)[:15] + "x"], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [word(), "@", word()]][form]

    for _ in range(EXAMPLES):
        words, spans = [word()], []
        for _ in range(2):
            if rng.random() < 0.55:
                kind = int(rng.integers(0, 4))
                own = entity(kind)
                spans.append((len(words), len(words) + len(own), kind + 1))
                words += own
            else:
                words += other()
            words += [word() for _ in range(rng.integers(1, 3))]
        yield words, spans


@dataclass(frozen=True)
class Field:
    """Weights by label and feature, and by two labels in sequence."""

    segment: np.ndarray
    sequence: np.ndarray


class Lattice:
    """Training lines side by side: features of every candidate segment by (line, end, length), and the sums over all segmentations."""

    def __init__(self, lines):
        n, labels = max(len(words) for words, _ in lines), len(KINDS) + 1
        self.lengths = np.array([len(words) for words, _ in lines])
        self.x = np.zeros((len(lines), n + 1, LONGEST + 1, _N_FEATURES))
        self.mask = np.full((len(lines), n + 1, LONGEST + 1, labels), -np.inf)
        self.gold = np.zeros(self.mask.shape)
        self.pairs = np.zeros((labels, labels))
        for e, (words, spans) in enumerate(lines):
            for j in range(1, len(words) + 1):
                for d in range(1, min(LONGEST, j) + 1):
                    self.x[e, j, d] = features(tuple(words[j - d : j]))
                    self.mask[e, j, d, 1 if d > 1 else 0 :] = 0  # "outside" covers one word at a time
            at, last, marked = 0, 0, {i: (j, label) for i, j, label in spans}
            while at < len(words):
                to, label = marked.get(at, (at + 1, 0))
                self.gold[e, to, to - at, label] = 1
                self.pairs[last, label] += 1
                at, last = to, label
            self.pairs[last, 0] += 1

    def expected(self, field: Field):
        """(log sum of each line, expected segments, expected label pairs)."""
        scores, t = self.x @ field.segment.T + self.mask, field.sequence
        lines, n, _, labels = scores.shape
        ahead, behind = np.full((lines, n, labels), -np.inf), np.full((lines, n, labels), -np.inf)
        ahead[:, 0, 0] = 0
        behind[np.arange(lines), self.lengths] = t[:, 0]
        total = lambda v: np.logaddexp.reduce(v, axis=1)
        for j in range(1, n):
            came = [total(ahead[:, j - d, :, None] + t)[:, :] + scores[:, j, d] for d in range(1, min(LONGEST, j) + 1)]
            ahead[:, j] = np.logaddexp.reduce(came, axis=0)
        for i in range(n - 2, -1, -1):
            go = [np.logaddexp.reduce(t[None] + (scores[:, i + d, d] + behind[:, i + d])[:, None, :], axis=2) for d in range(1, min(LONGEST, n - 1 - i) + 1)]
            behind[:, i] = np.logaddexp(behind[:, i], np.logaddexp.reduce(go, axis=0))
        z = behind[:, 0, 0]
        segments, pairs = np.zeros(scores.shape), np.zeros(t.shape)
        for j in range(1, n):
            for d in range(1, min(LONGEST, j) + 1):
                p = np.exp(ahead[:, j - d, :, None] + t + (scores[:, j, d] + behind[:, j])[:, None, :] - z[:, None, None])
                segments[:, j, d], pairs = p.sum(1), pairs + p.sum(0)
        last = ahead[np.arange(lines), self.lengths] + t[:, 0] - z[:, None]
        pairs[:, 0] += np.exp(last).sum(0)
        return z, segments, pairs


@lru_cache(2)
def trained(seed: int = 3) -> Field:
    """The field's weights: regularised log-likelihood, climbed with Adam steps."""
    lattice = Lattice(list(_invented(seed)))
    labels = len(KINDS) + 1
    w, m, v = (np.zeros(labels * (_N_FEATURES + labels)) for _ in range(3))
    part = lambda w: Field(w[: labels * _N_FEATURES].reshape(labels, -1), w[labels * _N_FEATURES :].reshape(labels, -1))
    for step in range(1, ROUNDS + 1):
        _, segments, pairs = lattice.expected(part(w))
        by_segment = np.einsum("ejdl,ejdf->lf", lattice.gold - segments, lattice.x)
        gradient = np.concatenate([by_segment.ravel(), (lattice.pairs - pairs).ravel()]) / EXAMPLES * 10 - 0.02 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w = w + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return part(w)


_INNER, _TAIL, _HEAD, _BARE = re.compile(r"[0-9][)./-]+[0-9]"), re.compile(r"[0-9][)./-]*$"), re.compile(r"[)./-]*[0-9]"), re.compile(r"[)./-]+$")


@lru_cache(1 << 16)
def word_facts(word: str) -> tuple[int, ...]:
    """What a word adds to the features of its segments: digits, letters, groups of digits, groups that are no byte, groups not of two to four digits,
    dots, a stretch within, a digit at the end and at the start but for marks, a plus or bracket first, a hook, and whether only the plain
    way holds (an ``@``, a spelt-out mark, marks alone)."""
    groups = re.findall(r"[0-9]+", word)
    return (
        sum(map(len, groups)), sum(c.isalpha() for c in word), len(groups), sum(len(g) > 3 or int(g) > 255 for g in groups), sum(not 2 <= len(g) <= 4 for g in groups), word.count(".") + word.lower().count("[.]"),
        bool(_INNER.search(word)), bool(_TAIL.search(word)), bool(_HEAD.match(word)), word[0] in "+(", bool(_HOOK.search(word)), "@" in word or bool(_AT.match(word) or _DOT.match(word) or _BARE.match(word)),
    )


def segment_scores(words: list[str], field: Field) -> list[np.ndarray]:
    """By length from 1: the scores of all labels for the segments that begin at each word. Features come from running sums over the words; segments
    with a word that sums can't hold are looked at one by one."""
    facts = np.array([word_facts(w) for w in words]).reshape(len(words), 12)
    sums = np.concatenate([np.zeros((1, 12), int), facts.cumsum(axis=0)])
    meets = np.concatenate([[0, 0], (facts[:-1, 7] & facts[1:, 8]).cumsum()])[: len(words) + 1]  # stretches over the blank before a word
    out = []
    for size in range(1, min(LONGEST, len(words)) + 1):
        n = len(words) - size + 1
        digits, letters, groups, large, odd_groups, dots, inner, _, _, _, hooks, plain = (sums[size:] - sums[:n]).T
        bare = (letters == 0) & (digits > 0)
        card = bare & (digits >= 13) & (digits <= 19)
        x = np.zeros((n, _N_FEATURES))
        x[:, 0], x[:, 1], x[:, 2] = 1, size == 1, (size - 1) / LONGEST
        x[:, 3], x[:, 4], x[:, 5], x[:, 6] = digits == 0, bare, bare & (digits >= 9) & (digits <= 12), card
        for k in np.flatnonzero(card & (hooks > 0)):
            x[k, 7] = luhn(only_digits("".join(words[k : k + size])))
        x[:, 8] = bare & (digits >= 9) & (facts[:n, 9] > 0)
        x[:, 9] = bare & ((inner > 0) | (meets[size : size + n] - meets[1 : n + 1] > 0))
        x[:, 10] = bare & (groups == 4) & (large == 0) & (dots >= 3)
        x[:, 14] = bare & (groups >= 3) & (groups <= 5) & (digits >= 10) & (digits <= 12) & (odd_groups == 0)
        x[:, 15] = (letters > 0) & (digits > 0)
        for k in np.flatnonzero((plain > 0) & ((hooks > 0) | (size == 1))):
            x[k] = features(tuple(words[k : k + size]))
        scores = x @ field.segment.T
        scores[hooks == 0, 1:] = -np.inf
        out.append(scores)
    return out


#: Scores are whole multiples of 2**-SCALE in the decoding, so that equal ones are equal however they are summed.
SCALE, NEVER = 32, -(1 << 60)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), np.rint(np.ldexp(np.where(np.isfinite(x), x, 0), SCALE)), NEVER).astype(np.int64)


def decoded(words: list[str], field: Field) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (first word, end, label), each with a hook and at least MARGIN better than leaving its words
    outside; before and after the words lies "outside". A segment that loses against "outside" whatever stands beside it is left out
    beforehand, and the words between those that are left are stepped over at once."""
    pairs, n, labels = _whole(field.sequence), len(words), len(KINDS) + 1
    scores = [_whole(x) for x in segment_scores(words, field)]
    run = np.concatenate([[0], scores[0][:, 0].cumsum()])
    most = (pairs[:, 1:] - pairs[:, :1]).max(axis=0) + (pairs[1:] - pairs[:1]).max(axis=1)  # that its neighbours may add to a label against "outside"
    one, two = pairs[:, 1:], pairs[1:]
    against = np.array([[(one[:, k] - one[:, h]).max() + (two[k] - two[h]).max() for k in range(len(KINDS))] for h in range(len(KINDS))])
    found = []
    for size, own in enumerate(scores, 1):
        alone = run[size:] - run[: len(own)] + (size - 1) * pairs[0, 0]
        keep = own[:, 1:] + most > alone[:, None]
        for k in range(len(KINDS)):  # nor labels that another one beats by more than neighbours can make up for
            keep[:, k] &= ~(own[:, 1:] - own[:, k + 1 : k + 2] > against[:, k]).any(axis=1)
        i, k = np.nonzero(keep)
        found.append(np.stack([i + size, i, k + 1, own[i, k + 1]]))
    left = np.concatenate(found, axis=1)
    left = left[:, np.lexsort((left[2], left[1], left[0]))]
    ends, starts, kinds, values = left.tolist()
    t, sums, at = pairs.tolist(), run.tolist(), 0
    best, into, back = {}, {}, {}

    def reached(j, here):
        """Keep the best score of each label that ends at j, and what each label that begins there gets from them."""
        best[j] = here
        there = [a for a in range(labels) if here[a] > NEVER]
        into[j] = [max([(here[a] + t[a][b], -a) for a in there]) for b in range(labels)] if len(there) > 1 else [(here[there[0]] + x, -there[0]) for x in t[there[0]]]

    reached(0, [0] + [NEVER] * len(KINDS))
    p = 0
    for j in sorted({n, *ends, *starts} - {0}):
        value, a = into[p][0]
        here = [value + sums[j] - sums[p] + (j - p - 1) * t[0][0]] + [NEVER] * len(KINDS)
        back[j, 0] = (p, -a, 0)
        while at < len(ends) and ends[at] == j:
            i, k, own = starts[at], kinds[at], values[at]
            value, a = into[i][k]
            if value + own > here[k]:
                here[k], back[j, k] = value + own, (i, -a, own)
            at += 1
        reached(j, here)
        p = j
    out, j, label, after = [], n, -into[n][0][1], 0
    while j:
        i, before, own = back[j, label]
        if label:
            alone = t[before][0] + sums[j] - sums[i] + (j - i - 1) * t[0][0] + t[0][after]
            if t[before][label] + own + t[label][after] - alone >= MARGIN * (1 << SCALE):
                out.append((i, j, label))
        j, label, after = i, before, label
    return out[::-1]


_DATE = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.][0-3]?[0-9](?![0-9])|(?<![0-9])[0-3]?[0-9][-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)[0-9]{2}(?![0-9])")


def plausible(kind: int, span: str) -> bool:
    """What a span of the field must be besides: a card passes its check sum, and neither a card nor a phone number holds a date."""
    if KINDS[kind] == "card" and not (13 <= len(d := only_digits(span)) <= 19 and luhn(d)):
        return False
    return KINDS[kind] not in ("card", "phone") or not _DATE.search(span)


def field_spans(text: str, weights: Field, reach: int = LONGEST - 1) -> list[tuple[int, int, int]]:
    """(kind, start, end) found by the field. A window reaches ``reach`` whole words beyond each word with a hook; windows that meet are
    one."""
    hooks = [m.start() for m in _HOOK.finditer(text)]
    if not hooks:
        return []
    bounds = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in bounds]
    found, windows, last = [], [], -1
    for hook in hooks:
        k = bisect_right(starts, hook) - 1
        if k > last:
            low, high, last = max(0, k - reach), min(len(bounds), k + reach + 1), k
            if windows and low <= windows[-1][1]:
                windows[-1][1] = high
            else:
                windows.append([low, high])
    for low, high in windows:
        window = bounds[low:high]
        words = [text[a:b].strip(",;:!?\"'").rstrip(".") or text[a:b] for a, b in window]
        for i, j, kind in decoded(words, weights):
            a, b = window[i][0], window[j - 1][1]
            while b > a and text[b - 1] in ".,;:!?\"'":
                b -= 1
            while a < b and text[a] in ",;:!?\"'":
                a += 1
            found.append((kind - 1, a, b))
    return found


class Finder:
    """Base spans of texts, and with them the field's."""

    def __init__(self, weights: Field):
        self.weights = weights

    def find(self, text: str):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        extra = set()
        for kind, a, b in field_spans(text, self.weights):
            if not plausible(kind, text[a:b]):
                continue
            before = bisect_left(starts, b)  # base spans that begin before this one ends
            if not before or ends[before - 1] <= a:
                extra.add((kind, a, b))
        return base, sorted([*base, *extra])


def rendered(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans (all).

    A null text is an empty one. Repeated rows give repeated rows, a null doc_id stays null, other columns are not looked at.
    """
    weights = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        finder = Finder(weights.value)

        def f(doc_id, text):
            found = [finder.find(x.decode("utf-8", "replace")) for x in as_bytes(text)]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(4)]
            return doc_id, *counts, [hashlib.sha256(rendered(b).encode()).hexdigest() for b, _ in found], [rendered(a) for _, a in found]

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def masked(docs: DataFrame) -> DataFrame:
    """The rows with each span of the text replaced by ``<KIND>``; overlapping spans become one, named after the first."""
    weights, columns = docs.sparkSession.sparkContext.broadcast(trained()), docs.columns
    at = columns.index("text")

    def make():
        finder = Finder(weights.value)

        def clean(text: str) -> str:
            out, done = [], 0
            for kind, a, b in sorted(finder.find(text)[1], key=lambda s: (s[1], -s[2])):
                if a >= done:
                    out += [text[done:a], f"<{KINDS[kind].upper()}>"]
                done = max(done, b)
            return "".join([*out, text[done:]])

        def f(*own):
            texts = [None if x is None else clean(x) for x in own[at].to_pylist()]
            return [texts if k == at else c for k, c in enumerate(own)]

        return f

    return map_batches(docs, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes), make)
