"""Parsers: files (path, base_name, rel_path, format, text) to items (path, pos, title, content, type, tags, source_meta, format)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.functions import columns as C
from notelake.functions import helpers as H
from notelake.operators.chunking import chunked, part_title


def plain_items(df: DataFrame, tags: Column | None = None, meta: Column | None = None, pos: str = "_n") -> DataFrame:
    """Rows with path, format, title, content as items at place ``pos``."""
    none = F.array().cast("array<string>")
    return df.select("path", F.col(pos).cast("int").alias("pos"), "title", "content", F.lit("reference").alias("type"), (tags if tags is not None else none).alias("tags"), (meta if meta is not None else F.lit(None).cast("map<string,string>")).alias("source_meta"), "format")


def as_items(df: DataFrame, place: str | None = None, tags: Column | None = None, meta: Column | None = None) -> DataFrame:
    """Rows with path, format, title, content as chunked, titled items; ``place`` orders the rows of a file (by default it has one)."""
    none = F.array().cast("array<string>")
    rows = df.select("path", "format", (F.col(place) if place else F.lit(0)).cast("long").alias("_n"), "title", "content", (tags if tags is not None else none).alias("tags"), (meta if meta is not None else F.lit(None).cast("map<string,string>")).alias("source_meta"))
    parts = chunked(rows).withColumn("title", part_title(F.col("title"), F.col("part"), F.col("n_parts")))
    if place:
        parts = parts.withColumn("part", F.row_number().over(W.partitionBy("path").orderBy("_n", "part")))
    return plain_items(parts, F.col("tags"), F.col("source_meta"), "part")


def front_matter(text: Column) -> Column:
    """Struct of title, tags and body of a Markdown text (PAR-1): tags inline, with or without brackets, or as a block."""
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
    head = F.regexp_replace(F.regexp_extract(text, pattern, 1), "\r", "")
    tag = lambda c: F.regexp_replace(C.ws_trim(c), "^[\"'#]|[\"']$", "")
    inline = F.split(F.regexp_replace(F.regexp_extract(head, r"(?m)^tags:[ \t]*(.*)$", 1), r"^\[|\]$", ""), ",")
    block = F.split(F.regexp_extract(head, r"(?m)^tags:[ \t]*\n((?:[ \t]+-[ \t]+[^\n]*\n?)+)", 1), "\n")
    block = F.transform(block, lambda t: F.regexp_replace(t, r"^[ \t]+-[ \t]+", ""))
    tags = F.array_distinct(F.filter(F.transform(F.concat(inline, block), tag), lambda t: t != ""))
    title = C.ws_trim(F.regexp_replace(F.regexp_extract(head, r"(?m)^title:[ \t]*(.*)$", 1), "^[\"']|[\"']$", ""))
    return F.struct(F.nullif(title, F.lit("")).alias("title"), tags.alias("tags"), F.regexp_replace(text, pattern, "").alias("body"))


def _headed(title: Column, heading: Column) -> Column:
    return F.when(heading.isNotNull(), F.concat(title, F.lit(" — "), heading)).otherwise(title)


def split_sections(df: DataFrame, most: int | None = 4000) -> DataFrame:
    """(path, title, body) to (path, sec, title, content): split at level 1 and 2 headings outside code fences; sections of ``most``
    characters together, or a single one, are one record with its headings (never with most=None). Each text is cut within its row."""
    found = df.select("path", "title", H.markdown_sections(F.col("body")).alias("_s")).filter("size(_s) > 0")
    total = F.aggregate("_s", F.lit(0), lambda n, x: n + F.length(x["text"]))
    found = found.withColumn("_one", (F.size("_s") == 1) | (total <= most) if most is not None else F.lit(False))
    whole = F.array_join(F.transform("_s", lambda x: F.concat(F.when(x["heading"].isNotNull(), F.concat(F.lit("## "), x["heading"], F.lit("\n\n"))).otherwise(""), x["text"])), "\n\n")
    apart = F.transform("_s", lambda x, k: F.struct(k.alias("sec"), _headed(F.col("title"), x["heading"]).alias("title"), x["text"].alias("content")))
    recs = F.when(F.col("_one"), F.array(F.struct(F.lit(0).alias("sec"), F.col("title").alias("title"), whole.alias("content")))).otherwise(apart)
    return found.select("path", F.explode(recs).alias("r")).select("path", F.col("r.sec").cast("long").alias("sec"), "r.title", "r.content")


def parse_markdown(files: DataFrame) -> DataFrame:
    own = files.select("path", "format", "base_name", front_matter(F.col("text")).alias("f"))
    named = own.select("path", "format", F.col("f.tags").alias("tags"), F.coalesce("f.title", "base_name").alias("title"), F.col("f.body").alias("body"))
    secs = split_sections(named).join(named.select("path", "format", "tags"), "path")
    return as_items(secs, "sec", F.col("tags"))


def parse_text(files: DataFrame) -> DataFrame:
    return as_items(files.select("path", "format", F.col("base_name").alias("title"), F.col("text").alias("content")))


def html_to_text(html: Column) -> Column:
    return C.squeezed(H.decode_entities(C.html_skeleton(html)))


def parse_html(files: DataFrame) -> DataFrame:
    title = F.coalesce(F.nullif(C.ws_trim(F.regexp_replace(H.decode_entities(C.html_title(F.col("text"))), r"\s+", " ")), F.lit("")), "base_name")
    return as_items(files.select("path", "format", title.alias("title"), html_to_text(F.col("text")).alias("content")))


def _cells(head: Column, cells: Column, clean=lambda v: v) -> Column:
    """(h, v) for each column of the header; missing cells are empty, cells beyond it don't count."""
    return F.transform(head, lambda h, k: F.struct(h.alias("h"), clean(F.coalesce(F.get(cells, k), F.lit(""))).alias("v")))


def _labelled(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit(": "), p["v"])), "\n")


def parse_csv(files: DataFrame, group: int = 50) -> DataFrame:
    """Fifty rows a record; more rows give records titled by their rows. Records are grouped within the file's row."""
    rows = files.withColumn("_r", H.csv_rows(F.col("text"))).filter("size(_r) > 1")
    head, n = F.element_at("_r", 1), F.size("_r") - 1
    rows = rows.select("path", "format", "base_name", head.alias("_h"), F.slice("_r", F.lit(2), n).alias("_d"), n.alias("_all"))
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_all") / group).cast("int") - 1)))
    own = F.slice("_d", F.col("g") * group + 1, F.lit(group))
    text = F.array_join(F.transform(own, lambda r: _labelled(_cells(F.col("_h"), r))), "\n\n---\n\n")
    label = F.concat("base_name", F.lit(" (rows "), (F.col("g") * group + 1).cast("string"), F.lit("-"), (F.col("g") * group + F.size(own)).cast("string"), F.lit(")"))
    title = F.when(F.col("_all") > group, label).otherwise(F.col("base_name"))
    recs = rows.select("path", "format", (F.col("g") + 1).alias("_n"), title.alias("title"), text.alias("content"), F.size(own).cast("string").alias("_k"), F.array_join("_h", ",").alias("_c"))
    return plain_items(recs, meta=F.create_map(F.lit("rows"), F.col("_k"), F.lit("columns"), F.col("_c")))


def parse_json_doc(files: DataFrame) -> DataFrame:
    return as_items(files.select("path", "format", F.col("base_name").alias("title"), H.pretty_json(F.col("text")).alias("content")).filter("content IS NOT NULL"))


def _dated(key: str, date: str) -> Column:
    return F.when(F.col(date).isNotNull(), F.create_map(F.lit(key), F.col(date)))


def parse_enex(files: DataFrame) -> DataFrame:
    """A record for each note with text; the first untitled one has no number."""
    note = files.select("path", "format", "base_name", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<note>(.*?)</note>"), 1)).alias("n", "x"))
    pick = lambda tag: C.ws_trim(F.regexp_extract("x", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    body = F.regexp_replace(pick("content"), r"(?s)^<!\[CDATA\[|\]\]>$", "")
    rows = note.select("path", "format", "base_name", "n", "x", html_to_text(body).alias("content"), F.nullif(pick("title"), F.lit("")).alias("_t")).filter("content <> ''")
    count = F.sum(F.col("_t").isNull().cast("int")).over(W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_c", count)
    untitled = F.concat("base_name", F.lit(" — untitled note"), F.when(F.col("_c") > 1, F.concat(F.lit(" ("), F.col("_c").cast("string"), F.lit(")"))).otherwise(""))
    own = F.filter(F.transform(F.regexp_extract_all("x", F.lit(r"(?s)<tag>(.*?)</tag>"), 1), C.ws_trim), lambda t: t != "")
    date = F.coalesce(F.try_to_timestamp(pick("created"), F.lit("yyyyMMdd'T'HHmmss'Z'")), C.to_iso(pick("created")))
    rows = rows.select("path", "format", "n", F.coalesce("_t", untitled).alias("title"), "content", F.concat(F.array(F.lit("evernote")), own).alias("_tags"), C.iso_time(date).alias("_date"))
    return as_items(rows, "n", F.col("_tags"), _dated("note_date", "_date"))


KEEP = "title string, textContent string, isArchived boolean, isTrashed boolean, userEditedTimestampUsec long, labels array<struct<name:string>>, listContent array<struct<text:string,isChecked:boolean>>"


def parse_keep(files: DataFrame) -> DataFrame:
    """Text and list of a note, a blank line between them; blank list entries and labels don't count."""
    rows = files.withColumn("k", F.from_json("text", KEEP)).filter("NOT coalesce(k.isArchived, false) AND NOT coalesce(k.isTrashed, false)")
    full = lambda c: F.filter(c, lambda t: t != "")
    trimmed = lambda c: C.ws_trim(F.coalesce(c, F.lit("")))
    items = F.filter("k.listContent", lambda i: trimmed(i["text"]) != "")
    boxes = F.array_join(F.transform(items, lambda i: F.concat(F.when(i["isChecked"], "- [x] ").otherwise("- [ ] "), trimmed(i["text"]))), "\n")
    text = F.array_join(full(F.array(trimmed(F.col("k.textContent")), F.coalesce(boxes, F.lit("")))), "\n\n")
    labels = full(F.transform("k.labels", lambda x: trimmed(x["name"])))
    tags = F.concat(F.array(F.lit("keep")), F.coalesce(labels, F.array().cast("array<string>")))
    date = C.iso_time(F.when(F.col("k.userEditedTimestampUsec") > 0, F.timestamp_micros("k.userEditedTimestampUsec")))
    title = F.coalesce(F.nullif(C.ws_trim(F.col("k.title")), F.lit("")), "base_name")
    return as_items(rows.select("path", "format", title.alias("title"), text.alias("content"), tags.alias("_t"), date.alias("_d")), None, F.col("_t"), _dated("note_date", "_d"))


def parse_notion_md(files: DataFrame) -> DataFrame:
    rows = files.select("path", "format", C.notion_title(F.col("base_name")).alias("title"), C.notion_body(F.col("text")).alias("content"), C.notion_tags(F.col("rel_path")).alias("_t"))
    return as_items(rows, None, F.col("_t"))


def parse_notion_db(files: DataFrame) -> DataFrame:
    """A record for each row with a value; its title is its first cell."""
    rows = files.withColumn("base_name", C.notion_title(F.col("base_name"))).withColumn("_r", H.csv_rows(F.col("text"))).filter("size(_r) > 1")
    rows = rows.select("path", "format", "base_name", F.element_at("_r", 1).alias("_h"), F.posexplode(F.slice("_r", F.lit(2), F.size("_r") - 1)).alias("row", "cells"))
    pairs = F.filter(_cells(F.col("_h"), F.col("cells"), lambda v: C.ws_trim(C.notion_body(v))), lambda p: p["v"] != "")
    first = C.ws_trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    number = (F.col("row") + 1).cast("string")
    title = F.concat("base_name", F.lit(" — "), F.when(first != "", C.notion_title(first)).otherwise(F.concat(F.lit("Row "), number)))
    rows = rows.select("path", "format", (F.col("row") + 1).alias("_n"), title.alias("title"), _labelled(pairs).alias("content"), F.lower("base_name").alias("_db"), F.col("base_name").alias("_name"), number.alias("_row")).filter("content <> ''")
    return plain_items(rows, F.array(F.lit("notion"), F.lit("database"), F.col("_db")), F.create_map(F.lit("database"), F.col("_name"), F.lit("row"), F.col("_row")))


def split_converted(files: DataFrame) -> DataFrame:
    """Markdown that a converter made (PAR-17): a record for each slide or sheet; other texts, and slide sets without marks, by headings."""
    own = files.select("path", "format", F.col("base_name").alias("title"), C.sanitize_markdown(F.col("text")).alias("body"))
    mark = r"(?i)<!--\s*Slide number:\s*(\d+)\s*-->"
    marked = F.col("format").isin("pptx", "ppt") & F.col("body").rlike(mark)
    numbers = F.regexp_extract_all("body", F.lit(mark), 1)
    each = own.filter(marked).select("path", "format", "title", F.posexplode(F.arrays_zip(numbers.alias("n"), F.slice(F.split("body", mark), F.lit(2), F.size(numbers)).alias("x"))).alias("n", "s"))
    text, line = C.ws_trim(F.col("s.x")), r"(?m)^#{1,3}\s+(.*)$"
    heading = C.ws_trim(F.regexp_extract(text, line, 1))
    bare = C.ws_trim(F.regexp_replace(text, r"(?s)^(.*?)(?:(?<=\n)|(?<![\s\S]))#{1,3}\s+[^\n]*\n?(.*)$", "$1$2"))
    label = F.concat("title", F.lit(" — Slide "), F.col("s.n").cast("int").cast("string"), F.when(heading != "", F.concat(F.lit(" ("), heading, F.lit(")"))).otherwise(""))
    slides = each.select("path", "format", "n", label.alias("title"), F.when(bare != "", bare).otherwise(text).alias("content"), F.col("s.n").cast("int").cast("string").alias("_m"))
    rest = own.filter(~marked)
    sheet = F.col("format").isin("xlsx", "xls")
    secs = split_sections(rest.filter(sheet), None).unionByName(split_sections(rest.filter(~sheet))).join(files.select("path", "format"), "path")
    return as_items(slides, "n", meta=F.create_map(F.lit("slide"), F.col("_m"))).unionByName(as_items(secs, "sec"))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "markdown": parse_markdown, "text": parse_text, "csv": parse_csv, "json": parse_json_doc, "html": parse_html, "enex": parse_enex, "keep": parse_keep,
    "notion": parse_notion_md, "notion-db": parse_notion_db, **dict.fromkeys(C.CONVERTED, split_converted),
}


def register_parser(format: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    """A transform for a further format; an unknown one is ``skipped_unsupported``."""
    PARSERS[format] = parser
