"""Scalar functions as column expressions; all of them run in the JVM. Lengths count code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that searches leave out.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might can to of in for on with at by from
as and but or not so if when how what which who this that these those it its my our your their we you they about into over under all
any some
""".split()
#: Words that key terms leave out.
KEY_STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might can to of in for on with at by from
as and but or not so if when how what which who this that these those it its
""".split()
#: Formats by extension, those that come converted, and mail.
FORMATS = {"md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "csv": "csv", "json": "json", "html": "html", "htm": "html", "enex": "enex"}
CONVERTED = {x: x for x in ("pdf", "docx", "xlsx", "pptx", "epub", "doc", "xls", "ppt")}
MAIL = {"eml": "eml", "mbox": "mbox"}
#: Blanks that trimming takes away: those of Unicode and the byte order mark.
BLANKS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MB = 1 << 20
#: Fixed value: one reply or forward prefix of a subject.
SUBJECT_PREFIX = r"(?:re|fwd?|aw|sv|odp)(?:\s*\[\d+\])?\s*:\s*"
#: What turns HTML into text, in this order; entities are decoded after it.
HTML_STEPS = (
    (r"(?is)<(script|style|noscript|iframe|svg|head)\b.*?</\1>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(p|div|li|h[1-6]|tr|blockquote|section|article)>", "\n\n"),
    (r"<[^>]+>", " "),
)
SQUEEZE_STEPS = ((r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"))


def ws_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def map_lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


# FN-1 … FN-15


def summary(content: Column) -> Column:
    """Up to 200 characters as they are; else cut at the last sentence end past 80, else at a blank, with dots."""
    head = F.substring(content, 1, 200)
    last = lambda mark: 200 - F.instr(F.reverse(head), mark[::-1]) - 1
    at = lambda mark: F.when(F.instr(head, mark) > 0, last(mark)).otherwise(-1)
    end = F.greatest(*(at(m) for m in (". ", "! ", "? ")))
    blank = F.when(F.instr(head, " ") > 0, 200 - F.instr(F.reverse(head), " ")).otherwise(-1)
    cut = F.when(end > 80, F.substring(head, F.lit(1), end + 1)).when(blank > 0, F.concat(F.substring(head, F.lit(1), blank), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(content) <= 200, content).otherwise(cut)


def slugify(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 200)


def content_hash(content: Column) -> Column:
    return F.sha2(ws_trim(content), 256)


def words(text: Column) -> Column:
    """Runs of three small letters and digits or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), 0)


def tokenize(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))


def stem(word: Column) -> Column:
    """The first suffix rule that fits; ing and ed also undo a doubled consonant."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    undo = lambda c: F.when(F.length(c) >= 3, F.regexp_replace(c, r"([^aeiou])\1$", "$1")).otherwise(c)
    return (
        F.when(word.endswith("ies") & (n > 4), cut(3))
        .when(word.endswith("ing") & (n > 5), undo(cut(3)))
        .when(word.endswith("ed") & (n > 4), undo(cut(2)))
        .when(word.endswith("es") & (n > 4), cut(2))
        .when(word.endswith("s") & (n > 3) & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(tokenize(text), stem))


def fallback_terms(query: Column, alias_terms: Column, most: int = 8) -> Column:
    own = F.transform(tokenize(query), stem)
    more = F.flatten(F.transform(F.coalesce(alias_terms, F.array().cast("array<string>")), lambda a: F.transform(tokenize(a), stem)))
    return F.slice(F.array_distinct(F.filter(F.concat(own, more), lambda w: F.length(w) >= 3)), 1, most)


def key_terms(title: Column, content: Column) -> Column:
    both = F.concat_ws(" ", title, F.substring(content, 1, 200))
    words = F.split(F.regexp_replace(F.lower(both), r"[^a-z0-9\s]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*KEY_STOP_WORDS))), 1, 5)


def decay_score(last_validated: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of) - F.unix_micros(last_validated)) / F.lit(86_400_000_000.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / 180)), F.lit(0.0))


def normalize_subject(subject: Column) -> Column:
    bare = F.regexp_replace(ws_trim(subject), f"(?i)^(?:{SUBJECT_PREFIX})++", "")
    return ws_trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def is_reply(subject: Column) -> Column:
    """Whether a subject begins with a reply or forward prefix."""
    return F.coalesce(ws_trim(subject).rlike(f"(?i)^{SUBJECT_PREFIX}"), F.lit(False))


def bare_subject(subject: Column) -> Column:
    """A subject without its first prefix; null where nothing but prefixes is there."""
    return F.when(normalize_subject(subject) != "", F.nullif(ws_trim(F.regexp_replace(subject, f"(?i)^{SUBJECT_PREFIX}", "")), F.lit("")))


def display_name(sender: Column) -> Column:
    name = ws_trim(F.substring_index(sender, "<", 1))
    name = F.when(name.rlike('^".*"$') & (F.length(name) >= 2), ws_trim(F.regexp_replace(name, '^"|"$', ""))).otherwise(name)
    bare = ws_trim(F.regexp_replace(sender, "[<>]", ""))
    return F.when((F.instr(sender, "<") > 1) & (name != ""), name).when(bare != "", bare).otherwise("Unknown sender")


def addresses(sender: Column, to: Column) -> Column:
    text = F.concat_ws(" ", sender, to)
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([\w.+-]+@[\w-]+\.[\w.-]+)"), 1), F.lower))


def to_iso(value: Column) -> Column:
    """Epoch seconds above zero, or an ISO text; else null."""
    text = value.cast("string")
    number = F.when(text.rlike(r"^[0-9.]+(E[0-9]+)?$"), F.expr("1")).isNotNull()
    seconds = F.when(number, text.try_cast("double"))
    return F.when(seconds > 0, F.timestamp_micros((seconds * 1e6).cast("long"))).when(~number, text.try_cast("timestamp"))


def relation_hint(source: Column, target: Column) -> Column:
    return (
        F.when(source == target, "supports")
        .when(((source == "lesson") & (target == "decision")) | ((source == "decision") & (target == "lesson")), "derived_from")
        .when((source == "insight") & (target == "pattern"), "derived_from")
        .when((source == "pattern") & (target == "insight"), "example_of")
        .otherwise("supports")
    )


def clipped_tags(tags: Column) -> Column:
    return F.transform(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 20), lambda t: F.substring(t, 1, 100))


# DET-1 … DET-6


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def detect_format(path: Column) -> Column:
    return map_lookup(FORMATS | CONVERTED | MAIL, extension(path))


def refine_json(content: Column) -> Column:
    """The shape of a JSON text by its first 65,536 characters; only ``current_node`` may come later."""
    head = F.substring(content, 1, 65_536)
    objects = head.rlike(r"^\s*\[\s*\{")
    return (
        F.when(head.rlike(r"^\s*\{") & head.contains('"userEditedTimestampUsec"'), "keep")
        .when(objects & head.contains('"mapping"') & content.contains('"current_node"'), "chatgpt")
        .when(objects & head.contains('"chat_messages"'), "claude")
        .otherwise("json")
    )


def refine_path(name: Column) -> Column:
    """notion page, notion database, its duplicate that is skipped, or null."""
    has_id = lambda tail: name.rlike(rf"(?i) [0-9a-f]{{32}}{tail}$")
    return F.when(has_id(r"\.md"), "notion").when(has_id(r"_all\.csv"), "skip").when(has_id(r"\.csv"), "notion-db")


def looks_binary(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    control = F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    return (F.regexp_count(head, F.lit(r"\x00")) > 0) | (control > 0.05 * F.length(head))


def decode_text(content: Column) -> Column:
    return F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), "^﻿", "")


def size_limit(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name == "conversations.json", F.lit(200 * MB)).when(name.endswith(".mbox"), F.lit(4096 * MB)).otherwise(F.lit(10 * MB))


# PAR-5, PAR-12, PAR-18 in their built-in parts


def html_skeleton(html: Column) -> Column:
    """Markup to text, character entities left in place."""
    return reduce(lambda c, step: F.regexp_replace(c, *step), HTML_STEPS, html)


def squeezed(text: Column) -> Column:
    return ws_trim(reduce(lambda c, step: F.regexp_replace(c, *step), SQUEEZE_STEPS, text))


def html_title(html: Column) -> Column:
    """The title's text, entities left in place."""
    return F.nullif(ws_trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def sanitize_markdown(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?is)<(script|iframe|object|embed|style)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<(script|iframe|object|embed)\b[^>]*>", "")
    t = F.regexp_replace(t, r"""(?i)\s+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    return F.regexp_replace(t, r"(?i)(\]\(\s*)javascript:[^)]*\)", "$1#)")


def render_slack_text(text: Column, users: Column) -> Column:
    """Mentions by the user map (a map column), channels, links as ``label (url)``, then lt, gt, amp."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(r"<@([A-Z0-9]+)(?:\|[^>]*)?>"), 1))
    plain = F.regexp_replace(text, r"<@([A-Z0-9]+)\|[^>]*>", "<@$1>")
    named = F.aggregate(ids, plain, lambda t, u: F.replace(t, F.concat(F.lit("<@"), u, F.lit(">")), F.concat(F.lit("@"), F.coalesce(users[u], u))))
    t = F.regexp_replace(named, r"<#[A-Z0-9]+\|([^>]+)>", "#$1")
    t = F.regexp_replace(t, r"<(https?://[^|>]+)\|([^>]+)>", "$2 ($1)")
    t = F.regexp_replace(t, r"<(https?://[^>]+)>", "$1")
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")], t)


def notion_title(name: Column) -> Column:
    """A name without the page id at its end; the name itself where nothing else is there."""
    return F.coalesce(F.nullif(ws_trim(F.regexp_replace(name, r"(?i) [0-9a-f]{32}$", "")), F.lit("")), ws_trim(name))


def notion_body(text: Column) -> Column:
    """Page ids taken out of link texts and targets."""
    inside = F.regexp_replace(text, r"(?i)(?<=\[[^\[\]]{0,500}) [0-9a-f]{32}\s*(?=\]\()", "")
    return F.regexp_replace(inside, r"(?i)(?<=\]\([^()]{0,2000})(?:%20| )[0-9a-f]{32}(?=\.(?:md|csv)|\)|/)", "")


def notion_tags(rel_path: Column) -> Column:
    parts = F.split(rel_path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.concat(F.array(F.lit("notion")), F.filter(F.transform(folders, lambda p: F.lower(notion_title(p))), lambda p: p != ""))


def iso_time(t: Column) -> Column:
    """A timestamp (UTC session) as text with milliseconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
