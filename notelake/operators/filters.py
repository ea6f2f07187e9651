"""Filters, scopes, sorts and pages over record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Collections with an owner.
SCOPED = ("knowledge", "decisions", "sessions", "goals", "tasks", "contacts", "handoffs", "knowledge_links")
#: By collection, the fields that a query may compare and those that a search looks at.
FILTER_FIELDS = {
    "knowledge": ["type"], "decisions": [], "sessions": [], "goals": ["status", "timeframe"], "tasks": ["status", "priority"], "contacts": ["relationship"],
    "prospects": ["stage"], "blog_posts": ["status"], "content_calendar": ["platform", "status"], "email_queue": ["status"],
}
SEARCH_FIELDS = {"decisions": ["title", "context", "chosen_option"], "contacts": ["name", "company", "notes", "role"], "prospects": ["name", "company", "notes", "email"]}


def clause(field: str, op: str, value) -> Column:
    """One comparison; eq and neq are null-safe, like is a literal substring in any case, contains looks into an array."""
    c, v = F.col(field), F.lit(value) if not isinstance(value, (list, tuple)) else None
    plain = {"gt": lambda: c > v, "gte": lambda: c >= v, "lt": lambda: c < v, "lte": lambda: c <= v}
    if op in plain:
        return plain[op]()
    if op == "eq":
        return c.eqNullSafe(v)
    if op == "neq":
        return ~c.eqNullSafe(v)
    if op == "like":
        return F.lower(c).contains(str(value).lower())
    if op == "in":
        return c.isin(*value)
    if op == "contains":
        return F.array_contains(c, value)
    raise ValueError(f"unknown comparison: {op}")


def apply_filter(df: DataFrame, groups) -> DataFrame:
    """OR of ANDs of (field, op, value); no groups: all rows."""
    if not groups:
        return df
    every = [reduce(lambda a, b: a & b, (clause(*x) for x in g), F.lit(True)) for g in groups]
    return df.filter(reduce(lambda a, b: a | b, every))


def owners_of(owner: str, shared: str, owner_scope=None) -> list[str]:
    known = {"private": owner, "shared": shared}
    scopes = ["private", "shared"] if owner_scope is None else [owner_scope] if isinstance(owner_scope, str) else list(owner_scope)
    if bad := [s for s in scopes if s not in known]:
        raise ValueError(f"unknown owner scope: {bad[0]}")
    return list(dict.fromkeys(known[s] for s in scopes))


def scope(df: DataFrame, collection: str, owner: str, shared: str, owner_scope=None) -> DataFrame:
    """Rows that the owner may read."""
    wanted = owners_of(owner, shared, owner_scope)
    return df.filter(F.col("owner_id").isin(*wanted)) if collection in SCOPED else df


def stamp_owner(df: DataFrame, collection: str, owner: str, shared: str, update: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with their owner, rejected rows). The pseudo-column owner_scope is resolved and dropped."""
    if collection not in SCOPED:
        return df, df.limit(0)
    for name in ("owner_scope", "owner_id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    asked, given = F.col("owner_scope"), F.col("owner_id")
    bad = (given.isNotNull() & ~given.isin(owner, shared)) | (asked.isNotNull() & ~asked.isin("private", "shared"))
    implied = F.when(asked == "shared", shared).when(asked == "private", owner).when(given.isNotNull(), given)
    stamped = implied if update else F.coalesce(implied, F.lit(owner))
    return df.filter(~bad).withColumn("owner_id", stamped).drop("owner_scope"), df.filter(bad)


def sort_records(df: DataFrame, clauses=(("created_at", "desc"),), tie: str = "id") -> DataFrame:
    """Ascending with nulls first, descending with nulls last, then by id."""
    keys = [F.col(f).desc_nulls_last() if d == "desc" else F.col(f).asc_nulls_first() for f, d in clauses]
    return df.orderBy(*keys, F.col(tie).asc())


def page(df: DataFrame, limit: int = 50, offset: int = 0, total: bool = True, clauses=(("created_at", "desc"),)):
    """(items, facts): the page counts from 1; the total ignores it and is counted only if asked for."""
    facts = {"page": offset // limit + 1, "per_page": limit, "total": df.count() if total else None}
    return sort_records(df, clauses).offset(offset).limit(limit), facts


def query_collection(df: DataFrame, collection: str, owner: str, shared: str, filters=None, tags=None, owner_scope=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Equality on allowed fields; all tags must be there (knowledge); newest first."""
    if bad := [f for f in filters or {} if f not in FILTER_FIELDS[collection]]:
        raise ValueError(f"{collection} can't be filtered by {bad[0]}")
    out = apply_filter(scope(df, collection, owner, shared, owner_scope), [[(f, "eq", v) for f, v in filters.items()]] if filters else None)
    if tags:
        if collection != "knowledge":
            raise ValueError("only knowledge has a tag filter")
        out = out.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return sort_records(out).offset(offset).limit(limit)


def recent(df: DataFrame, owner: str, shared: str, type: str | None = None, owner_scope=None, limit: int = 10) -> DataFrame:
    return query_collection(df, "knowledge", owner, shared, {"type": type} if type else None, None, owner_scope, limit)


def handoff_inbox(df: DataFrame, owner: str, shared: str, to_member=None, status=None, task_id=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """``me`` is the current owner."""
    own = [(f, "eq", owner if f == "to_member" and v == "me" else v) for f, v in (("to_member", to_member), ("status", status), ("task_id", task_id)) if v is not None]
    return sort_records(apply_filter(scope(df, "handoffs", owner, shared), [own] if own else None)).offset(offset).limit(limit)


def drop_bulk(messages: DataFrame, include_bulk: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, bulk mails skipped by path)."""
    bulk = messages.filter("is_bulk").groupBy("path").agg(F.count("*").alias("bulk_skipped"))
    return (messages, bulk.limit(0)) if include_bulk else (messages.filter("NOT coalesce(is_bulk, false)"), bulk)


def get_records(df: DataFrame, ids: DataFrame, collection: str, owner: str, shared: str) -> tuple[DataFrame, DataFrame]:
    """(found, ids not found): a record of another owner is not found."""
    seen = scope(df, collection, owner, shared)
    return seen.join(ids, "id", "left_semi"), ids.join(seen, "id", "left_anti")


def count_records(df: DataFrame, groups=None) -> DataFrame:
    return apply_filter(df, groups).agg(F.count("*").alias("n"))
