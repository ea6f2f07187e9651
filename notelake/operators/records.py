"""Record maintenance: validated loads, patches, upserts, handoffs, deletion. Rules are data; one engine serves all collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.operators.filters import SCOPED, scope

TAGS = ("tags", 20, 100)
STAGES = "new contacted responded interested ready_to_buy proposal_sent negotiating closed_won closed_lost nurturing".split()
TEXT, PRIORITY = (None, 5000), ("low", "medium", "high", "urgent")
#: By collection and field, (least, greatest length), a tuple of allowed words, "int", "float01", or TAGS; names of required
#: fields; fields that only an update knows, fields that an update doesn't know; defaults of absent fields. Collections in NOT_PATCHED have no
#: updates.
RULES = {
    "knowledge": dict(required=["type", "title", "content"], fields={"type": ("fact", "pattern", "insight", "lesson", "reference"), "title": (1, 500), "content": (1, 10_000), "tags": TAGS, "source": (None, 500), "confidence": "float01"}, fixed=["type"], defaults={"confidence": 0.8}),
    "decisions": dict(required=["title", "options_considered", "chosen_option"], fields={"title": (1, 500), "context": TEXT, "options_considered": ("options", None, 500), "chosen_option": (1, 500), "rationale": TEXT, "tags": TAGS}, defaults={}),
    "goals": dict(required=["title", "timeframe"], fields={"title": (1, 500), "description": TEXT, "timeframe": ("daily", "weekly", "monthly", "quarterly", "yearly"), "key_results": "any", "tags": TAGS}, update={"status": ("active", "completed", "paused", "abandoned")}, fixed=["timeframe"], defaults={"status": "active"}),
    "tasks": dict(required=["title"], fields={"title": (1, 500), "description": TEXT, "priority": PRIORITY, "due_date": (None, 50), "tags": TAGS, "goal_id": (1, None)}, update={"status": ("todo", "in_progress", "done", "cancelled")}, fixed=["goal_id"], defaults={"status": "todo", "priority": "medium"}),
    "contacts": dict(required=["name"], fields={"name": (1, 200), "company": (None, 200), "role": (None, 200), "email": (None, 200), "phone": (None, 50), "relationship": ("colleague", "client", "prospect", "partner", "other"), "notes": TEXT, "tags": TAGS}, update={"last_contact_date": (None, 50)}, defaults={}),
    "prospects": dict(required=["name"], fields={"name": (1, 200), "email": (None, 200), "company": (None, 200), "role": (None, 200), "stage": tuple(STAGES), "source": (None, 200), "estimated_value": "int", "next_action_type": (None, 100), "next_followup_date": (None, 50), "notes": (None, 10_000), "tags": TAGS, "linkedin_url": (None, 500)}, update={"last_contact_date": (None, 50)}, defaults={"stage": "new"}),
    "blog_posts": dict(required=["title", "content"], fields={"title": (1, 500), "slug": (None, 200), "content": (1, 100_000), "excerpt": (None, 500), "status": ("draft", "published", "archived"), "tags": TAGS, "seo_title": (None, 200), "seo_description": (None, 300), "og_image_url": (None, 500)}, defaults={"status": "draft"}),
    "content_calendar": dict(required=["title", "platform"], fields={"title": (1, 500), "content": (None, None), "platform": ("linkedin", "newsletter", "blog", "twitter", "other"), "pillar": (None, 100), "status": ("idea", "drafting", "ready", "published"), "scheduled_date": (None, 50), "persona": (None, 100)}, update={"published_url": (None, 500)}, defaults={"status": "idea"}),
    "email_queue": dict(required=["to_email", "subject", "body_html"], fields={"to_email": (1, 200), "to_name": (None, 200), "subject": (1, 500), "body_html": (1, 50_000), "body_text": (None, None), "sequence_id": (None, 100), "sequence_step": "int", "prospect_id": (1, None), "scheduled_at": (None, None)}, defaults={"status": "queued"}),
    "handoffs": dict(required=["title", "what_changed"], fields={"title": (1, 500), "to_member": (None, 200), "what_changed": (1, 10_000), "task_id": (1, None)}, defaults={"status": "open"}),
    "sessions": dict(required=["title"], fields={"title": (1, 500), "summary": (None, 5000), "duration_minutes": "int", "branch": (None, 200)}, defaults={}),
}
NOT_PATCHED = ("decisions", "sessions", "email_queue", "handoffs")
#: Collections whose records may be deleted.
DELETABLE = ("knowledge", "decisions", "blog_posts", "knowledge_links")
MANAGED = ("id", "created_at", "updated_at", "owner_id", "owner_scope")


def issue(field: str, rule) -> Column:
    """A message where the field breaks its rule, else null; a null field breaks none."""
    c = F.col(field)
    say = lambda cond, text: F.when(c.isNotNull() & cond, F.lit(f"{field}: {text}"))
    if rule == "any":
        return F.lit(None).cast("string")
    if rule == "int":
        return say(c.try_cast("long").isNull() | (c.try_cast("double") != c.try_cast("long")), "not a whole number")
    if rule == "float01":
        return say(c.try_cast("double").isNull() | (c.try_cast("double") < 0) | (c.try_cast("double") > 1), "not between 0 and 1")
    if rule[0] in ("tags", "options"):
        bad = F.exists(c, lambda t: F.length(t) > rule[2])
        bad = bad | (F.size(c) > rule[1]) if rule[1] else bad | (F.size(c) < 1)
        return say(bad, "too many or too long entries")
    if isinstance(rule[0], str):
        return say(~c.isin(*rule), "not an allowed value")
    least, most = rule
    bad = reduce(lambda a, b: a | b, [F.length(c) < least] * bool(least) + [F.length(c) > most] * bool(most), F.lit(False))
    return say(bad, "length out of range")


def checked(df: DataFrame, collection: str, update: bool = False) -> DataFrame:
    """The rows and their ``issues``."""
    spec = RULES[collection]
    if update and collection in NOT_PATCHED:
        raise ValueError(f"{collection} records can't be updated")
    fixed = spec.get("fixed", []) if update else []
    rules = {f: r for f, r in (spec["fields"] | (spec.get("update", {}) if update else {})).items() if f not in fixed}
    issues = [issue(f, r) for f, r in rules.items() if f in df.columns]
    if not update:
        issues += [F.when(F.col(f).isNull(), F.lit(f"{f}: required")) if f in df.columns else F.lit(f"{f}: required") for f in spec["required"]]
    issues += [F.when(F.col(f).isNotNull(), F.lit(f"{f}: unknown field")) for f in df.columns if f not in rules and f not in MANAGED and not f.startswith("_")]
    if collection == "handoffs" and {"owner_scope", "to_member", "owner_id"} <= set(df.columns):  # MNT-4
        issues.append(F.when((F.col("owner_scope") == "private") & F.col("to_member").isNotNull() & ~F.col("to_member").isin("me") & (F.col("to_member") != F.col("owner_id")), F.lit("owner_scope: a private handoff can't go to another member")))
    return df.withColumn("issues", F.array_compact(F.array(*issues)))


def load_records(collection: str, df: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with defaults and computed fields, rejected rows with issues)."""
    rows = checked(df, collection)
    good = rows.filter("size(issues) = 0").drop("issues")
    for f, v in RULES[collection]["defaults"].items():
        good = good.withColumn(f, F.coalesce(F.col(f), F.lit(v)) if f in good.columns else F.lit(v))
    for f in ("title", "name"):
        good = good.withColumn(f, C.ws_trim(F.col(f))) if f in good.columns else good
    if "tags" in RULES[collection]["fields"]:
        none = F.array().cast("array<string>")
        good = good.withColumn("tags", F.coalesce("tags", none) if "tags" in good.columns else none)
    if collection == "blog_posts":
        slug = C.slugify(F.col("title"))
        good = good.withColumn("slug", F.coalesce(F.nullif("slug", F.lit("")), slug) if "slug" in good.columns else slug).withColumn("published_at", F.when(F.col("status") == "published", as_of))
    if collection == "knowledge":
        good = good.withColumn("summary", C.summary(F.col("content"))).withColumn("last_validated_at", as_of)
    for f in {"contacts": ["last_contact_date"], "prospects": ["last_contact_date"], "decisions": ["outcome"], "email_queue": ["sent_at", "error"], "content_calendar": ["published_url"], "handoffs": ["accepted_at", "completed_at"]}.get(collection, []):
        good = good.withColumn(f, F.lit(None).cast("string"))
    return good.withColumn("created_at", as_of), rows.filter("size(issues) > 0")


def one_of_each(df: DataFrame, keys: list[Column], order: list[Column] | None = None) -> DataFrame:
    """The last row of each key by ``order``, by default by all columns that can be ordered."""
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    best = F.struct(*(order or [F.col(c) for c in plain])).alias("_o")
    named = df.withColumn("_key", F.struct(*keys))
    return named.groupBy("_key").agg(F.max_by(F.struct(*df.columns), best).alias("_row")).select("_row.*")


def patch_records(df: DataFrame, patches: DataFrame, collection: str, as_of: Column, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows after the patches, patches of unknown ids, rejected patches). Only given fields change; an empty patch does nothing. Of
    several patches of one id the last by ``order`` counts (by default by their values)."""
    rows = checked(patches, collection, update=True)
    good, bad = rows.filter("size(issues) = 0").drop("issues"), rows.filter("size(issues) > 0")
    good = one_of_each(good, [F.col("id")], order)
    fields = [f for f in patches.columns if f != "id" and f in df.columns]
    given = good.select(F.col("id"), *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_hit"))
    met = df.join(given, "id", "left")
    some = reduce(lambda a, b: a | b, (F.col(f"_{f}").isNotNull() for f in fields), F.lit(False))
    out = {f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}
    if collection == "knowledge" and "content" in fields:
        out["summary"] = F.when(F.col("_content").isNotNull(), C.summary(F.col("_content"))).otherwise(F.col("summary"))
    if collection == "knowledge" and "title" in fields:
        out["title"] = F.coalesce(C.ws_trim(F.col("_title")), F.col("title"))
    if collection == "blog_posts" and "status" in fields:
        out["published_at"] = F.when(F.col("_status") == "published", as_of).when(F.col("_status").isNotNull(), F.lit(None)).otherwise(F.col("published_at"))
    out["updated_at"] = F.when(some, as_of).otherwise(F.col("updated_at"))
    return met.withColumns(out).drop("_hit", *(f"_{f}" for f in fields)), good.join(df, "id", "left_anti"), bad


def advance_handoffs(df: DataFrame, changes: DataFrame, as_of: Column, order: list[Column] | None = None) -> DataFrame:
    """Handoffs after (id, status); the time of acceptance or completion is stamped once. Of several changes of one id the last by ``order``
    counts (by default by their values)."""
    last = one_of_each(changes, [F.col("id")], order)
    met = df.join(last.select("id", F.col("status").alias("_status")), "id", "left")
    stamp = lambda field, status: F.coalesce(F.col(field), F.when(F.col("_status") == status, as_of))
    return met.withColumns({"accepted_at": stamp("accepted_at", "accepted"), "completed_at": stamp("completed_at", "completed"), "status": F.coalesce("_status", "status")}).drop("_status")


def revalidate(df: DataFrame, ids: DataFrame, owner: str, shared: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with last_validated_at reset, ids not found)."""
    seen = scope(df, "knowledge", owner, shared).join(ids, "id", "left_semi").select("id", F.lit(True).alias("_hit"))
    out = df.join(seen, "id", "left").withColumn("last_validated_at", F.when(F.col("_hit"), as_of).otherwise(F.col("last_validated_at"))).drop("_hit")
    return out, ids.join(seen, "id", "left_anti")


def upsert(df: DataFrame, incoming: DataFrame, collection: str, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows matched on keys (text in any case, the owner too where there is one) are updated, others added. Of several new rows of one key
    the last by ``order`` counts (by default by their values)."""
    keys = [*keys, "owner_id"] if collection in SCOPED and "owner_id" not in keys else keys
    kinds = dict(df.dtypes)
    key = [(F.lower(k) if kinds[k] == "string" else F.col(k)).alias(k) for k in keys]
    old, new = df.withColumn("_k", F.struct(*key)), one_of_each(incoming, key, order).select(F.struct(*key).alias("_k"), F.struct(*incoming.columns).alias("_new"))
    met = old.join(new, "_k", "full")
    return met.select(*(F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in incoming.columns and c != "id" else (F.coalesce(F.col(c), F.col(f"_new.{c}")) if c in incoming.columns else F.col(c)).alias(c) for c in df.columns))


def seed_missing(df: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    return df.unionByName(defaults.join(df, keys, "left_anti"), allowMissingColumns=True)


def soft_delete(df: DataFrame, ids: DataFrame, collection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, archived, ids not found)."""
    if collection not in DELETABLE:
        raise ValueError(f"{collection} records can't be deleted")
    return df.join(ids, "id", "left_anti"), df.join(ids, "id", "left_semi"), ids.join(df, "id", "left_anti")
