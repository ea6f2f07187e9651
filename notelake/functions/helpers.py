"""The only pandas and Arrow code outside the training-data operators: small per-row parsers that expressions can't hold."""

from __future__ import annotations

import email
import email.header
import email.policy
import email.utils
import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from notelake.functions.columns import HTML_STEPS, SQUEEZE_STEPS
from notelake.functions.columns import STOP_WORDS as _STOPPED

#: Named character entities.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…",
    "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’",
}
STOP_WORDS = frozenset(_STOPPED)
BODY_MOST, HTML_MOST, HEADER_MOST, REFERENCES_MOST = 16 << 10, 64 << 10, 1024, 50


def small_batches() -> None:
    """Bound what a Python worker holds at once: at most 512 rows, and about 8 MB, an Arrow batch. Without it a batch has 10,000 rows of any size."""
    conf = SparkSession.getActiveSession().conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def vectorized(kind: str):
    """A function of series as one of columns; the UDF is made where it is called, as workers import this module without a session."""
    def named(f):
        def column(*columns):
            small_batches()
            return F.pandas_udf(f, kind)(*columns)

        return column

    return named


def _code_point(number: int, whole: str) -> str:
    return chr(number) if 0 < number < 0x110000 and not 0xD800 <= number < 0xE000 else whole


def entities(text: str) -> str:
    text = re.sub(r"&#[xX]([0-9a-fA-F]{1,8});", lambda m: _code_point(int(m[1], 16), m[0]), text)
    text = re.sub(r"&#([0-9]{1,9});", lambda m: _code_point(int(m[1]), m[0]), text)
    return re.sub(r"&([A-Za-z0-9_]+);", lambda m: ENTITIES.get(m[1].lower(), m[0]), text)


def _series(f):
    return lambda s: s.map(lambda x: None if x is None else f(x))


@vectorized("string")
def decode_entities(s: pd.Series) -> pd.Series:
    return _series(entities)(s)


def chunks(text: str, most: int = 4000) -> list[str]:
    """Paragraphs packed up to ``most`` characters; longer ones cut at a line end, else a blank, else hard."""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    out, held = [], ""
    for part in re.split(r"\n{2,}", text):
        if held and len(held) + 2 + len(part) > most:
            out.append(held)
            held = ""
        held = f"{held}\n\n{part}" if held else part
        while len(held) > most:
            least = int(0.3 * most)
            cut = next((k for mark in ("\n", " ") if (k := held.rfind(mark, 0, most + 1)) >= least), most)
            out.append(held[:cut].rstrip())
            held = held[cut:].lstrip()
    return [y for x in [*out, held] if (y := x.strip())]


def chunk_text(text, most: int = 4000):
    """The chunks of a text column as an array (CHK-1)."""

    @vectorized("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else chunks(x, most))

    return run(text)


#: What a quoted line and an attribution look like.
_QUOTED = re.compile(r"\s*>")
_ATTRIBUTION = re.compile(r"\s*(?:On .{0,200}wrote:?\s*$|-{2,}\s*(?:Original Message|Forwarded message)\s*-{2,})", re.I)
#: Of line kinds (q quoted, b blank, a attribution, t text): a run of at least two quoted lines with what stands above it; an attribution
#: right above a quoted line.
_RUNS = re.compile(r"(?<![ab])[ab]*+qb*q[qb]*|a(?=q)")


def _kind(line: str) -> str:
    return "q" if _QUOTED.match(line) else "b" if not line.strip() else "a" if _ATTRIBUTION.match(line) else "t"


def without_quotes(body: str) -> str:
    """Runs of two quoted lines or more go, with the attribution above; a single quoted line stays. Lines become letters, so that the runs
    are found by one pattern."""
    lines = body.split("\n")
    gone = set()
    for m in _RUNS.finditer("".join(map(_kind, lines))):
        gone.update(range(*m.span()))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for k, x in enumerate(lines) if k not in gone)).strip()


@vectorized("string")
def trim_quotes(s: pd.Series) -> pd.Series:
    return _series(without_quotes)(s)


#: A field (plain characters and quoted stretches in any mix) and what ends it.
_FIELD = re.compile(r'((?:[^",\n]++|"(?:[^"]|"")*+(?:"|\Z))*+)(,|\n|\Z)')
_STRETCH = re.compile(r'"((?:[^"]|"")*+)(?:"|\Z)|\r')


def table_rows(text: str) -> list[list[str]]:
    """Rows of RFC 4180 text; a row of one blank field is left out."""
    out, row = [], []
    for m in _FIELD.finditer(text):
        if m.end() == m.start() and not row:  # the end of the text after a line end
            break
        row.append(_STRETCH.sub(lambda q: (q[1] or "").replace('""', '"'), m[1]))
        if m[2] != ",":
            if len(row) > 1 or row[0].strip():
                out.append(row)
            row = []
            if not m[2]:
                break
    return out


@vectorized("array<array<string>>")
def csv_rows(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [] if x is None else table_rows(x))


#: Lines that open or close a code fence, and headings of the first two levels.
_MARKS = re.compile(r"^(?:(```|~~~).*|#{1,2}\s+?(?=\S|$)[ \t]*(.*))$", re.M)


def sections_of(body: str) -> list[tuple[str | None, str]]:
    """(heading or None, text) between level 1 and 2 headings outside code fences; those without text are left out."""
    bounds, fenced = [(0, 0, None)], False
    for m in _MARKS.finditer(body):
        if m[1]:
            fenced = not fenced
        elif not fenced:
            bounds.append((m.start(), m.end(), m[2].strip() or None))
    ends = [start for start, _, _ in bounds[1:]] + [len(body)]
    found = [(heading, body[end:stop].strip()) for (_, end, heading), stop in zip(bounds, ends)]
    return [x for x in found if x[1]]


@vectorized("array<struct<heading:string,text:string>>")
def markdown_sections(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"heading": h, "text": t} for h, t in sections_of(x or "")])


def packed(keys: list[str], most: int, whole: bool = False):
    """For mapInPandas over (keys, text) sorted by keys and place: (keys, part, content). Whole messages are packed up to ``most`` characters
    and joined by two line ends, an oversized one is chunked on its own (or stays ``whole``); only the current chunk is held."""

    def run(frames):
        key, part, held = None, 0, ""
        for frame in frames:
            rows = []

            def done(text):
                nonlocal part
                part += 1
                rows.append((*key, part, text))

            for *own, text in frame[[*keys, "text"]].itertuples(index=False, name=None):
                if own != key:
                    if held:
                        done(held)
                    key, part, held = own, 0, ""
                if held and len(held) + 2 + len(text) > most:
                    done(held)
                    held = ""
                if len(text) > most:
                    for piece in [text] if whole else chunks(text, most):
                        done(piece)
                else:
                    held = f"{held}\n\n{text}" if held else text
            yield pd.DataFrame(rows, columns=[*keys, "part", "content"])
        if held:
            yield pd.DataFrame([(*key, part + 1, held)], columns=[*keys, "part", "content"])

    return run


@vectorized("string")
def pretty_json(s: pd.Series) -> pd.Series:
    """JSON with two blanks of indent; null where it is none."""

    def f(x):
        try:
            return json.dumps(json.loads(x), indent=2, ensure_ascii=False)
        except ValueError:
            return None

    return _series(f)(s)


def _value(text: str):
    text = text.strip()
    if text in ("null", "~", ""):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text[0] in "[{\"":
        try:
            return json.loads(text)
        except ValueError:
            if text[0] == "[":
                return [str(_value(x) or "") for x in text[1:-1].split(",") if x.strip()]
    if text[0] == "'" and text[-1] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    return float(text) if re.fullmatch(r"-?[0-9]+\.[0-9]+", text) else int(text) if re.fullmatch(r"-?[0-9]{1,18}", text) else text


def front_matter_of(text: str) -> tuple[dict, str]:
    """Typed fields of a front matter, and the body."""
    m = re.match(r"﻿?---\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text
    fields, key = {}, None
    for line in m[1].splitlines():
        if (item := re.match(r"\s+-\s*(.*)$", line) or re.match(r"-\s+(.*)$", line)) and key is not None:
            fields[key] = [*(fields[key] if isinstance(fields[key], list) else []), _value(item[1])]
        elif pair := re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line):
            key = pair[1]
            fields[key] = _value(pair[2])
    return fields, text[m.end() :].lstrip("\n")


@vectorized("struct<fields:string,body:string>")
def read_front_matter(s: pd.Series) -> pd.DataFrame:
    rows = [front_matter_of(x or "") for x in s]
    return pd.DataFrame([(json.dumps(f), b) for f, b in rows], columns=["fields", "body"])


def rendered_record(fields: dict, body: str) -> str:
    lines = []
    for k, v in fields.items():
        if isinstance(v, list) and v:
            lines += [f"{k}:", *(f"  - {json.dumps(x, ensure_ascii=False)}" for x in v)]
        else:
            lines.append(f"{k}: {json.dumps(v, ensure_ascii=False)}")
    return "---\n" + "\n".join(lines) + f"\n---\n\n{body}"


@vectorized("string")
def render_front_matter(fields: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([rendered_record(json.loads(f or "{}"), b or "") for f, b in zip(fields, body)])


# PAR-19

MESSAGE = "path string, pos long, message_id string, in_reply_to string, references array<string>, subject string, sender string, recipient string, date timestamp, body string, attachments array<string>, is_bulk boolean, error string"


def _header(message, name: str) -> str:
    try:
        raw = ", ".join(str(x) for x in message.get_all(name, []))
        text = str(email.header.make_header(email.header.decode_header(raw)))
    except Exception:  # a header that can't be decoded stays as it is
        text = str(message.get(name, ""))
    return re.sub(r"\s+", " ", text).strip()[:HEADER_MOST]


def _text(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


_CLOSERS = re.compile(r"(?i)</(?:script|style|noscript|iframe|svg|head)>")


def html_text(html: str) -> str:
    """The steps of ``columns.html_skeleton`` and ``squeezed`` for the HTML part of a mail. Elements and tags are sought up to the last place
    that can close one, so unclosed ones stay cheap."""
    text = html[:HTML_MOST]
    for k, step in enumerate(HTML_STEPS):
        ends = [m.end() for m in _CLOSERS.finditer(text)] if k == 0 else []
        cut = (ends[-1] if ends else 0) if k == 0 else text.rfind(">") + 1
        text = re.sub(*step, text[:cut]) + text[cut:]
    return reduce(lambda t, step: re.sub(*step, t), SQUEEZE_STEPS, entities(text)).strip()


def parsed_message(raw: str) -> dict:
    message = email.message_from_string(raw)
    plain = html = None
    names, todo = [], [(message, 0)]
    while todo:
        part, depth = todo.pop(0)
        if part.is_multipart():
            todo = [(p, depth + 1) for p in part.get_payload() if depth < 10] + todo
        elif part.get_filename():
            names.append(part.get_filename())
        elif part.get_content_type() == "text/plain" and plain is None:
            plain = _text(part)
        elif part.get_content_type() == "text/html" and html is None:
            html = _text(part)
    ids = lambda s: re.findall(r"<([^<>\s]+)>", s)
    try:
        date = email.utils.parsedate_to_datetime(message.get("Date", ""))
        date = pd.Timestamp(date).tz_convert("UTC").tz_localize(None) if date.tzinfo else pd.Timestamp(date)
    except (TypeError, ValueError, OverflowError):
        date = None
    body = plain if plain and plain.strip() else html_text(html or "")
    first = lambda s: (ids(s) or [None])[0]
    bulk = bool(message.get("List-Unsubscribe")) or _header(message, "Precedence").lower() in ("bulk", "list", "junk")
    return {
        "message_id": first(message.get("Message-ID", "")), "in_reply_to": first(message.get("In-Reply-To", "")),
        "references": ids(str(message.get("References", "")))[-REFERENCES_MOST:], "subject": _header(message, "Subject"), "sender": _header(message, "From"),
        "recipient": _header(message, "To"), "date": date, "body": body.replace("\r\n", "\n")[:BODY_MOST].strip(), "attachments": names, "is_bulk": bulk, "error": None,
    }


def parse_messages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (path, pos, raw); a message that can't be read becomes a row with an error."""
    names = [x.split(" ")[0] for x in MESSAGE.split(", ")]
    for frame in frames:
        rows = []
        for path, pos, raw in zip(frame.path, frame.pos, frame.raw):
            try:
                own = parsed_message(raw or "")
            except Exception as e:  # one broken message doesn't stop the others
                own = {"error": str(e)[:500]}
            rows.append({"path": path, "pos": pos} | own)
        out = pd.DataFrame(rows, columns=names)
        out["date"] = pd.to_datetime(out["date"])
        yield out


#: Widths in bytes of the windows that needles are found by.
WIDTHS = (1, 2, 3, 4, 8, 16, 32, 64)
#: Bytes of text that one numpy step looks at, how far from its window a needle is checked there, and hits that a task holds.
PIECE, REACH, HELD = 1 << 18, 2048, 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _window_sums(b, most: int):
    """(width, a number of each window of that width) of bytes, for WIDTHS up to ``most``; up to 8 bytes the number is the window itself."""
    import numpy as np

    sums = {1: b.astype(np.uint64)}
    for w in WIDTHS:
        if w > most or w > len(b):
            return
        if w > 1:
            left, right = (2, 1) if w == 3 else (w // 2, w // 2)
            n = len(b) - w + 1
            sums[w] = sums[left][:n] * np.uint64(1 << 8 * right if w <= 8 else _BASE) + sums[right][left : left + n]
        yield w, sums[w]


def _spots(sums, bits: int):
    import numpy as np

    return (sums * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def needle_windows(needles: list[bytes]) -> dict:
    """By width: the needles whose longest window has it, each by the one of a few windows that the fewest of them share, and a second
    window, at its other end, that tells most of them apart."""
    import numpy as np

    sizes, out = np.array([len(x) for x in needles]), {}
    widths = np.array(WIDTHS)[np.searchsorted(WIDTHS, sizes, "right") - 1]
    for w in map(int, np.unique(widths)):
        own = np.flatnonzero(widths == w)
        n = sizes[own]
        begin = np.cumsum(n) - n
        sums = dict(_window_sums(np.frombuffer(b"".join(needles[k] for k in own), np.uint8), w))[w]
        places = np.stack([(n - w) * k // 4 for k in ((0, 4) if w <= 8 else range(5))])  # short needles: both ends hold all of it
        values, inverse, shared = np.unique(sums[begin + places], return_inverse=True, return_counts=True)
        chosen = shared[inverse.reshape(places.shape)].argmin(axis=0)
        at = places[chosen, np.arange(len(own))]
        check = np.where(at * 2 >= n - w, np.maximum(at - REACH, 0), np.minimum(at + REACH, n - w))
        order = np.argsort(sums[begin + at], kind="stable")
        keys, first, many = np.unique(sums[begin + at][order], return_index=True, return_counts=True)
        out[w] = {"keys": keys, "first": first, "many": many, "own": own[order], "at": at[order], "check": check[order], "sum": sums[begin + check][order], "size": n[order]}
    return out


def _found(column, needles: list[bytes], index: dict, filters: dict):
    """(needle, row) of the texts of an Arrow column that hold needles, each once. Numbers of windows give candidates, bytes decide."""
    import numpy as np
    import pyarrow as pa

    texts = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"").cast("B")[int(ends[0]) : int(ends[-1])]
    data, ends, most, pairs = np.frombuffer(raw, np.uint8), ends - ends[0], max(index, default=0), [np.empty(0, np.int64)]
    for start in range(0, len(data), PIECE):
        low, high = max(0, start - REACH), min(len(data), start + PIECE + REACH + most)
        stop = min(start + PIECE, len(data))
        for w, sums in _window_sums(data[low:high], most):
            if w not in index:
                continue
            x, (bits, met) = index[w], filters[w]
            new = sums[start - low : stop - low]
            at = np.flatnonzero(met[_spots(new, bits)])
            near = np.minimum(np.searchsorted(x["keys"], new[at]), len(x["keys"]) - 1)
            same = x["keys"][near] == new[at]
            at, near = at[same] + start, near[same]
            many = x["many"][near]
            k = np.repeat(x["first"][near] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = np.repeat(at, many)
            begin = at - x["at"][k]
            row = np.searchsorted(ends, at, "right") - 1
            fits = (begin >= ends[row]) & (begin + x["size"][k] <= ends[row + 1])
            k, begin, row = k[fits], begin[fits], row[fits]
            fits = sums[begin + x["check"][k] - low] == x["sum"][k]
            k, begin, row = x["own"][k[fits]], begin[fits], row[fits]
            key = k * len(texts) + row
            if w <= 8:  # two windows hold the whole needle
                pairs.append(np.unique(key))
                continue
            key, one = np.unique(key, return_index=True)
            same = [raw[b : b + len(needles[n])] == needles[n] for n, b in zip(k[one].tolist(), begin[one].tolist())]
            if not all(same):  # equal numbers of different windows: every place decides by itself
                same = [raw[b : b + len(needles[n])] == needles[n] for n, b in zip(k.tolist(), begin.tolist())]
                key = np.unique((k * len(texts) + row)[np.array(same, bool)])
            pairs.append(key)
    return np.divmod(np.unique(np.concatenate(pairs)), len(texts))


def _order(rows, first: list[tuple[str, str]]):
    """Row numbers of an Arrow table by ``first``, newest, id; undated ones last, ids that are null first."""
    import pyarrow.compute as pc

    keys = [*first, *([("created_at", "descending")] if "created_at" in rows.column_names else []), ("_named", "ascending"), ("id", "ascending")]
    return pc.sort_indices(rows.append_column("_named", pc.cast(pc.is_valid(rows["id"]), "int8")), sort_keys=keys)


def _first_of(values, limit: int):
    """Which of sorted values are among the first ``limit`` equal ones."""
    import numpy as np

    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[: len(values)]
    return np.arange(len(values)) - np.repeat(first, np.diff(np.r_[first, len(values)])) < limit


def _best(hits, limit: int):
    hits = hits.take(_order(hits, [("number", "ascending"), ("score", "descending")]))
    return hits.filter(_first_of(hits["number"].to_numpy(), limit))


def automaton_hits(needles: list[str], numbers: list[int], worth: list[int], limit: int):
    """For mapInArrow over (id, created_at where it counts, texts in order): (number of the needle, score, id, created_at), the best ``limit`` of each
    needle that a task holds at once. A text is read once for all needles; the first text that holds one decides what it is worth. It takes
    sums of windows of the texts, so that a needle costs some bytes and no states."""
    import numpy as np

    small_batches()
    own, index = [x.encode() for x in needles], needle_windows([x.encode() for x in needles]) if needles else {}

    def run(batches):
        import pyarrow as pa

        filters, names = {}, np.array(numbers, np.int64)
        worths = np.array(sorted(set(worth), reverse=True), np.int32)
        level = np.searchsorted(-worths, -np.array(worth, np.int32))
        for w, x in index.items():
            bits = min(24, max(10, int(len(x["keys"]) * 16).bit_length()))
            filters[w] = bits, np.zeros(1 << bits, bool)
            filters[w][1][_spots(x["keys"], bits)] = True
        held, n = [], 0
        for batch in batches:
            beside = batch.num_columns - len(worth)
            rows, found = batch.num_rows, [_found(batch.column(beside + k), own, index, filters) for k in range(len(worth))] if index and batch.num_rows else []
            if sum(len(f[0]) for f in found):
                known = pa.Table.from_batches([batch]).select(list(range(beside)))
                order = _order(known, []).to_numpy()
                place = np.empty(rows, np.int64)
                place[order] = np.arange(rows)
                key = np.sort(np.concatenate([(f[0] * rows + place[f[1]]) * len(worth) + k for k, f in enumerate(found)]))
                key, field = np.divmod(key[_first_of(key // len(worth), 1)], len(worth))  # of several fields the first
                key = np.sort((key // rows * len(worths) + level[field]) * rows + key % rows)
                key = key[_first_of(key // (rows * len(worths)), limit)]
                key, at = np.divmod(key, rows)
                columns = [pa.array(names[key // len(worths)]), pa.array(worths[key % len(worths)]), *known.take(pa.array(order[at])).columns]
                held.append(pa.Table.from_arrays(columns, names=["number", "score", *known.column_names]))
                n += len(at)
            if n > HELD:
                held = [_best(pa.concat_tables(held), limit)]
                n = len(held[0])
                if n > HELD // 2:
                    yield from held[0].to_batches()
                    held, n = [], 0
        if held:
            yield from _best(pa.concat_tables(held), limit).combine_chunks().to_batches()

    return run


_WORD = re.compile("[a-z0-9]{3,}")
_DOUBLED = re.compile(r"([^aeiou])\1$")


@lru_cache(1 << 18)
def stem(word: str) -> str | None:
    """``columns.stem`` of one word, null for a word that searches leave out."""
    if word in STOP_WORDS:
        return None
    n = len(word)
    if word.endswith("ies") and n > 4:
        return word[:-3]
    for end, least in (("ing", 5), ("ed", 4)):
        if word.endswith(end) and n > least:
            cut = word[: -len(end)]
            return _DOUBLED.sub(r"\1", cut) if len(cut) >= 3 else cut
    if word.endswith("es") and n > 4:
        return word[:-2]
    return word[:-1] if word.endswith("s") and n > 3 and not word.endswith("ss") else word


def record_stems(batches):
    """For mapInArrow over (id, text): (id, terms), the distinct stemmed words. A worker keeps the stems of words that it has met."""
    import pyarrow as pa

    for batch in batches:
        own = [list({stem(w) for w in set(_WORD.findall((x or "").lower()))} - {None}) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], names=["id", "terms"])


def term_blocks(size: int, entries: int):
    """For mapInArrow over (id, terms) in order: (part, at, ids, words, word_ends, ends, rows), blocks of at most ``size`` records, and about ``entries`` terms of
    records, of a partition: words one after another, where each ends in bytes, and where its records end among the places of records in ``rows``."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def block(held, at):
        ids, terms = (pa.concat_arrays([b.column(k) for b in held]) for k in range(2))
        words = terms.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(ids), dtype=np.uint16), terms.value_lengths().fill_null(0).to_numpy())
        number = words.indices.to_numpy()
        ends = np.cumsum(np.bincount(number, minlength=len(words.dictionary)))
        rows = row[np.argsort(number, kind="stable")]
        own = [x.encode() for x in words.dictionary.to_pylist()]
        word_ends = np.cumsum([len(x) for x in own], dtype=np.int32)
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([at], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x]) for x in (b"".join(own), word_ends.tobytes(), ends.astype(np.int32).tobytes(), rows.tobytes()))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "at", "ids", "words", "word_ends", "ends", "rows"])

    def run(batches):
        held, n, many, at = [], 0, 0, 0
        for batch in batches:
            own = len(batch.column(1).flatten())
            if held and many + own > entries:
                yield block(held, at)
                held, n, many, at = [], 0, 0, at + 1
            while n + batch.num_rows >= size:
                yield block([*held, batch.slice(0, size - n)], at)
                batch, held, n, at = batch.slice(size - n), [], 0, at + 1
                many, own = 0, len(batch.column(1).flatten())
            if batch.num_rows:
                held.append(batch)
                n, many = n + batch.num_rows, many + own
        if held:
            yield block(held, at)

    return run


def holding_sets(size: int, most_words: int):
    """For mapInArrow over rows sorted by key, kind and place, the sets (set_no, terms, most) of a key before its blocks (``term_blocks``): (set_no, id), the first
    ``most`` records in the order of blocks that hold all terms of a set. Blocks are met one by one. In each the places of a word are bits, of
    about ``most_words`` words at once, and sets are conjunctions of them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def gathered(held):
        """Sets, those of more terms first: numbers, how many are wanted, how many terms, where these begin; that order, all terms as numbers of words, the words."""
        own = pa.Table.from_batches(held)
        terms = pa.concat_arrays(own["terms"].chunks)
        many, words = terms.value_lengths().to_numpy(), terms.flatten().dictionary_encode()
        order = np.argsort(-many, kind="stable")
        return own["set_no"].to_numpy()[order], own["most"].to_numpy()[order].copy(), many[order], np.cumsum(many) - many, order, words.indices.to_numpy(), words.dictionary

    def word_bits(b, at):
        """A row of bits of records for each of the words at these places."""
        bits, begin = np.zeros((len(at), size // 8), np.uint8), np.r_[0, b["ends"][:-1]].astype(np.int64)
        for k in range(0, len(at), 1024):
            own = at[k : k + 1024]
            n = b["ends"][own] - begin[own]
            flags = np.zeros((len(own), size), bool)
            flags[np.repeat(np.arange(len(own)), n), b["rows"][np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
            bits[k : k + 1024] = np.packbits(flags, axis=1)
        return bits

    def held_by(b, sets):
        number, left, many, starts, order, own, asked = sets
        first = starts[order]
        place = pc.index_in(asked, value_set=b["words"]).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.logical_and.reduceat(place[own] >= 0, starts)[order]
        todo = np.flatnonzero((left > 0) & known)
        spot = np.full(len(asked), -1)
        for part in np.split(todo, np.flatnonzero(np.diff(np.cumsum(many[todo]) // most_words)) + 1):
            asks = np.zeros(len(asked), bool)
            for j in range(many[part].max(initial=0)):
                asks[own[first[part[many[part] > j]] + j]] = True
            met = np.flatnonzero(asks)
            bits, spot[met] = word_bits(b, place[met]), np.arange(len(met))
            for k in range(0, len(part), 1024):
                s = part[k : k + 1024]
                held = bits[spot[own[first[s]]]]
                for j in range(1, many[s[0]]):
                    n = np.searchsorted(-many[s], -j)  # those of more than j terms
                    held[:n] &= bits[spot[own[first[s[:n]] + j]]]
                eights = held.view(np.uint64)
                row, eight = np.nonzero(eights)
                some, bit = np.nonzero(np.unpackbits(eights[row, eight].view(np.uint8).reshape(-1, 8), axis=1))
                row, doc = row[some], eight[some] * 64 + bit
                n = np.bincount(row, minlength=len(s))
                fits = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < left[s][row]
                left[s] -= np.minimum(n, left[s])
                if fits.any():
                    yield pa.RecordBatch.from_arrays([pa.array(number[s[row[fits]]]), b["ids"].take(pa.array(doc[fits]))], names=["set_no", "id"])

    def run(batches):
        key, held, sets = None, [], None
        for batch in batches:
            keys, kinds = batch["key"].to_numpy(), batch["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for k, end in zip([0, *cuts], [*cuts, batch.num_rows]) if batch.num_rows else ():
                if keys[k] != key:
                    key, held, sets = keys[k], [], None
                if kinds[k] == 0:
                    held.append(batch.slice(k, end - k).select(["set_no", "terms", "most"]))
                elif held or sets:
                    held, sets = [], sets or gathered(held)
                    for j in range(k, end):
                        yield from held_by(_block_row(batch, j), sets)

    return run


def _block_row(batch, k: int):
    import numpy as np
    import pyarrow as pa

    raw = {c: batch[c][k].as_buffer() for c in ("words", "word_ends", "ends", "rows")}
    spots = np.r_[np.int32(0), np.frombuffer(raw["word_ends"], np.int32)]
    words = pa.StringArray.from_buffers(len(spots) - 1, pa.py_buffer(spots), raw["words"])
    return {"ids": batch["ids"][k].values, "words": words, "ends": np.frombuffer(raw["ends"], np.int32), "rows": np.frombuffer(raw["rows"], np.uint16)}


def _unit(vectors):
    import numpy as np

    own = np.stack(vectors.to_numpy()).astype(float)
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)


def far_apart(vectors: list, most: int):
    """Up to ``most`` of some vectors, each the farthest from those before it, at unit length."""
    import numpy as np

    own = _unit(pd.Series(vectors))
    chosen, near = [own[0]], np.full(len(own), np.inf)
    while len(chosen) < most:
        near = np.minimum(near, ((own - chosen[-1]) ** 2).sum(axis=1))
        if near.max() <= 1e-12:
            break
        chosen.append(own[near.argmax()])
    return np.stack(chosen)


def _distances(own, pivots):
    import numpy as np

    return np.sqrt(np.maximum((own**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * own @ pivots.T, 0))


def nearest_pivot(pivots):
    """For mapInPandas over (id, vector): the same and ``cell``, the nearest pivot."""

    def run(frames):
        for f in frames:
            if len(f):
                yield f.assign(cell=_distances(_unit(f.vector), pivots).argmin(axis=1).astype("int32"))

    return run


def vector_block(pivots):
    """For applyInPandas over the vectors of a block: (block, ids, numbers of unit length, low, high: the least and greatest distance to each pivot)."""
    import numpy as np

    def run(key, f):
        own = _unit(f.vector)
        far = _distances(own, pivots)
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "ids": [f.id.to_numpy(np.int64).tobytes()], "numbers": [own.tobytes()], "low": [far.min(axis=0)], "high": [far.max(axis=0)]})

    return run


def block_neighbours(k: int, beside: list[str] | None = None):
    """For mapInPandas over pairs of blocks (query_ids, query_numbers, ids, numbers): the k nearest of each query within the pair, with the
    columns ``beside``."""
    import numpy as np

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                names, ids = np.frombuffer(row.query_ids, np.int64), np.frombuffer(row.ids, np.int64)
                near = np.round(np.frombuffer(row.numbers).reshape(len(ids), -1) @ np.frombuffer(row.query_numbers).reshape(len(names), -1).T, 9)
                top = np.lexsort((np.broadcast_to(ids[:, None], near.shape), -near), axis=0)[:k]
                yield pd.DataFrame({"query_id": np.repeat(names, len(top)), "id": ids[top].T.ravel(), "score": np.take_along_axis(near, top, 0).T.ravel()}).assign(**{c: getattr(row, c) for c in beside or []})

    return run
