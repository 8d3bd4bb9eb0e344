"""Stored rows: listings, traces, claims of work, duplicates and comparisons."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim

#: Statuses that a worker may claim, and limits of listings.
CLAIMABLE = ("received", "extracted", "escalated_vlm")
CLAIMABLE_ROUTES = ("zugferd", "text", "image")
MOST_LISTED, LISTED, REVIEWED = 500, 50, 100
UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.IGNORECASE)
BLOCKING = ("C1_TOTALS", "C2_LINE_SUM", "C3_LINE_MATH", "C4_VAT_SUM")
SUMMARY = ("doc_id", "created_at", "updated_at", "filename", "status", "route", "page_count", "attempts", "parent_id", "error")
DETAIL = ("extracted", "canonical", "violations", "repairs", "features", "vendor", "segments", "markdown")
#: Limits of one request of files.
MOST_BYTES, MOST_FILES = 100 * 1024 * 1024, 50


def checked_limit(value, default: int = 100) -> int:
    """An integer from 1 to 500, or the default for None; anything else is an error."""
    if value is None:
        return default
    if not re.fullmatch(r"[0-9]+", str(value)) or not 1 <= int(value) <= MOST_LISTED:
        raise ValueError(f"limit must be an integer from 1 to {MOST_LISTED}")
    return int(value)


def checked_id(value: str) -> str:
    if not UUID.match(value or ""):
        raise ValueError("not an id")
    return value


def summary(docs: DataFrame) -> DataFrame:
    """What a listing shows of a document: no content and no payload."""
    return docs.select(*SUMMARY)


def detail(docs: DataFrame) -> DataFrame:
    """The summary and the payloads."""
    return docs.select(*SUMMARY, *DETAIL)


def looked_up(asked: DataFrame, docs: DataFrame, *columns: str, wait_for: str | None = None) -> DataFrame:
    """For each id asked for, ``code`` and columns of its row: 404 without a row, or where all columns are null; 409
    where the row's status is not the one to ``wait_for``; else 200. Columns are null unless the code is 200."""
    joined = asked.select("doc_id").join(docs.select("doc_id", F.col("status").alias("_status"), *columns, F.lit(True).alias("_there")), "doc_id", "left")
    none = ~F.coalesce("_there", F.lit(False))
    for c in columns[:1] if wait_for is None else ():
        none = none | F.col(c).isNull()
    late = F.lit(False) if wait_for is None else F.col("_status") != wait_for
    code = F.when(none, 404).when(late, 409).otherwise(200)
    return joined.select("doc_id", code.alias("code"), *[F.when(code == 200, F.col(c)).alias(c) for c in columns])


def claim(docs: DataFrame, most_attempts: int, limit: int = 1) -> DataFrame:
    """The documents that a worker takes next: of those that wait, the oldest. One reader plans a micro-batch, so that no
    row needs a lock."""
    return docs.where(claimable(most_attempts)).orderBy("created_at", "doc_id").limit(limit)


def intake(files: DataFrame, history: DataFrame) -> DataFrame:
    """A result for each file of requests (request, n, filename, content): doc_id, filename, content_hash and outcome.
    ``empty`` parts are skipped, a file past the limit of a request is ``too_many``, one over the limit of bytes
    ``too_large``, known content ``duplicate``, which names the document that holds it; the rest is ``stored``, the
    first of equal ones in the order of request and n."""
    size = F.length("content")
    place = F.row_number().over(Window.partitionBy("request").orderBy((size == 0).cast("int"), "n"))
    early = F.when(size == 0, "empty").when(place > MOST_FILES, "too_many").when(size > MOST_BYTES, "too_large")
    sized = files.withColumns({"early": early, "content_hash": content_hash(F.col("content"))}).drop("content")
    known = history.where(F.col("status") != "failed").groupBy("content_hash").agg(F.min("doc_id").alias("holder"))
    first = sized.where("early IS NULL").groupBy("content_hash").agg(F.min(F.struct("request", "n")).alias("first"))
    joined = sized.join(known, "content_hash", "left").join(first, "content_hash", "left")
    own = F.concat_ws("/", F.col("request").cast("string"), F.col("n").cast("string"))
    holder = F.coalesce(F.col("holder").cast("string"), F.concat_ws("/", F.col("first.request").cast("string"), F.col("first.n").cast("string")))
    outcome = F.coalesce("early", F.when(holder == own, "stored").otherwise("duplicate"))
    return joined.select("request", "n", "filename", "content_hash", outcome.alias("outcome"), F.when(outcome.isin("stored", "duplicate"), holder).alias("doc_id"))


def escalations(df: DataFrame, reason: Column) -> DataFrame:
    """Rows for the escalation sink, of the documents with a reason."""
    rows = df.select(F.col("doc_id").cast("string").alias("doc_id"), reason.alias("reason"), F.lit("open").alias("resolution"), F.current_timestamp().alias("at"))
    return rows.where(F.col("reason").isNotNull())


def leaves(value: Column, kind: T.DataType, path: Column | None = None) -> Column:
    """An array of (path, value) for everything below a nested value that is neither null nor a container, by dotted
    path; elements of lists go by their number from 0."""
    def under(name: Column) -> Column:
        return name if path is None else F.concat_ws(".", path, name)

    none = F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, T.StructType):
        parts = [leaves(value[f.name], f.dataType, under(F.lit(f.name))) for f in kind]
        return F.concat(none, *parts)
    if isinstance(kind, T.ArrayType):
        each = F.flatten(F.transform(value, lambda x, i: leaves(x, kind.elementType, under(i.cast("string")))))
        return F.coalesce(each, none)
    one = F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))
    return F.when(value.isNotNull(), one).otherwise(none)


def set_path(value: Column, kind: T.DataType, path: str, new: Column) -> Column:
    """A nested value with the leaf at a dotted path replaced. Containers that are null are made, with all else null;
    a list grows up to the number asked for."""
    name, _, rest = path.partition(".")
    if isinstance(kind, T.StructType):
        own = {f.name: f.dataType for f in kind}
        if name not in own:
            raise ValueError(f"no field {name!r}")
        made = [set_path(value[n], t, rest, new) if n == name and rest else (new.cast(t) if n == name else value[n]).alias(n) for n, t in own.items()]
        return F.struct(*[m.alias(n) for m, n in zip(made, own, strict=True)]).cast(kind)
    if isinstance(kind, T.ArrayType):
        at = int(name)
        whole = F.sequence(F.lit(0), F.greatest(F.coalesce(F.size(value), F.lit(0)) - 1, F.lit(at)))

        def one(i: Column) -> Column:
            old = F.get(value, i)
            return F.when(i == at, set_path(old, kind.elementType, rest, new) if rest else new.cast(kind.elementType)).otherwise(old)

        return F.transform(whole, one).cast(kind)
    raise ValueError(f"nothing below {path!r}")


def nested_diff(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """All leaves that differ between two nested columns of one type: doc_id, path, expected, actual."""
    def rows(df: DataFrame) -> DataFrame:
        found = leaves(F.col(column), df.schema[column].dataType)
        return df.select("doc_id", F.inline(found))

    return diff(rows(expected), rows(actual))


def newest(docs: DataFrame, limit: int = LISTED, status: str | None = None, order: str = "created_at", tie: str = "doc_id") -> DataFrame:
    rows = docs if status is None else docs.where(F.col("status") == status)
    return rows.orderBy(F.desc(order), tie).limit(checked_limit(limit))


def claimable(most_attempts: int) -> Column:
    waiting = F.col("status").isin(*CLAIMABLE) | ((F.col("status") == "routed") & F.col("route").isin(*CLAIMABLE_ROUTES))
    return waiting & (F.col("attempts") < most_attempts)


def review_queue(docs: DataFrame, limit: int = REVIEWED) -> DataFrame:
    """Rows that wait for review, newest first, with the names of what they violate."""
    rows = newest(docs, limit, "pending_review")
    return rows.withColumn("failed", F.transform("violations", lambda v: v["constraint"]))


def trace(events: DataFrame, docs: DataFrame, root: Column) -> DataFrame:
    """The events of a document and of its children, by event id. ``root`` picks the documents asked for."""
    asked = docs.where(root).select(F.col("doc_id").alias("root"))
    family = asked.select("root", F.col("root").alias("doc_id")).unionAll(docs.join(asked, docs["parent_id"] == asked["root"]).select("root", docs["doc_id"]))
    return events.join(family, "doc_id").orderBy("root", "event_id")


def path(events: DataFrame, by: str, label: str, order: str) -> DataFrame:
    """One row per group: its events' labels in order, runs of one label once."""
    w = Window.partitionBy(by).orderBy(order)
    kept = events.withColumn("_last", F.lag(label).over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col(label)))
    hops = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(label).alias("l"))))
    return kept.groupBy(by).agg(F.array_join(F.transform(hops, lambda h: h["l"]), " > ").alias("path"), F.count("*").cast("int").alias("hops"))


def hop_label(event: Column, detail: Column) -> Column:
    """A short label of an event for the path of a document."""
    def part(name: str) -> Column:
        return F.get_json_object(detail, f"$.{name}")

    return (
        F.when(event == "routed", F.concat(F.lit("route:"), F.coalesce(part("route"), F.lit("?"))))
        .when(event == "text_gate", F.concat(F.lit("gate:"), F.coalesce(part("verdict"), F.lit("?"))))
        .when(event == "classified", F.concat(F.lit("class:"), F.coalesce(part("band"), F.lit("?"))))
        .when(event == "reconciled", F.concat(F.lit("solver:"), F.coalesce(part("status"), F.lit("?"))))
        .when(event == "stage_error", F.lit("error"))
        .otherwise(event)
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def fresh(batch: DataFrame, history: DataFrame, key: str = "content_hash", order: str = "doc_id") -> DataFrame:
    """Rows of a batch whose content is neither in the history, but for failed rows, nor earlier in the batch."""
    known = history.where(F.col("status") != "failed").select(key).distinct()
    first = batch.groupBy(key).agg(F.min(order).alias(order))
    return batch.join(first, [key, order], "left_semi").join(known, key, "left_anti")


def with_parent_content(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Children without a file of their own get their parent's. Documents without a parent are dealt by their own id, as
    all of them would meet in one task by the parent's."""
    own = files.select(F.col("doc_id"), F.col("content").alias("_own"))
    # Zero, but not a literal: the optimizer would take that out of the join's keys.
    nothing = F.xxhash64("doc_id").bitwiseAND(F.lit(0).cast("long"))
    parents = files.select(F.col("doc_id").alias("parent_id"), nothing.alias("_deal"), F.col("content").alias("_parent"))
    dealt = docs.join(own, "doc_id", "left").withColumn("_deal", F.when(F.col("parent_id").isNull(), F.xxhash64("doc_id")).otherwise(0).cast("long"))
    return dealt.join(parents, ["parent_id", "_deal"], "left").withColumn("content", F.coalesce("_own", "_parent")).drop("_own", "_parent", "_deal")


def children(docs: DataFrame) -> DataFrame:
    """A row for each invoice segment of a document of several: its pages, and a hash of parent and pages."""
    wanted = F.filter("segments", lambda s: s["kind"] == "invoice-candidate")
    rows = docs.where(F.size(wanted) > 1).select(F.col("doc_id").alias("parent_id"), F.posexplode(wanted).alias("n", "segment"))
    pages = F.array_join(F.transform("segment.pages", lambda p: p.cast("string")), ",")
    return rows.select("parent_id", "n", F.col("segment.pages").alias("pages"), F.sha2(F.concat_ws(":", F.col("parent_id").cast("string"), pages), 256).alias("content_hash"), F.lit("routed").alias("status"), F.lit("text").alias("route"))


def after_error(docs: DataFrame, errors: DataFrame, most_attempts: int) -> DataFrame:
    """``docs`` with an attempt more for each row of ``errors`` (doc_id, message); failed at the limit."""
    counted = errors.groupBy("doc_id").agg(F.count("*").cast("int").alias("_n"), F.max("message").alias("_message"))
    joined = docs.join(counted, "doc_id", "left")
    attempts = F.col("attempts") + F.coalesce("_n", F.lit(0))
    over = F.col("_n").isNotNull() & (attempts >= most_attempts)
    return joined.withColumns({"status": F.when(over, "failed").otherwise(F.col("status")), "error": F.coalesce("_message", "error"), "attempts": attempts}).drop("_n", "_message")


def resolved(escalations: DataFrame, done: DataFrame) -> DataFrame:
    """All escalations of a document take its resolution."""
    return escalations.join(done.select("doc_id", F.col("resolution").alias("_r")), "doc_id", "left").withColumn("resolution", F.coalesce("_r", "resolution")).drop("_r")


def commit_review(pending: DataFrame, corrections: DataFrame, solved: Column, issues: Column | None = None) -> DataFrame:
    """Corrections (doc_id, body) against pending rows: code and what blocks. 404 without a document, 409 where it does
    not wait for review, 400 where the body has ``issues`` with its schema, 422 where the arithmetic fails, else 200.
    ``solved``: violations of the submitted body."""
    joined = corrections.join(pending.select("doc_id", "status"), "doc_id", "left")
    blocking = F.filter(solved, lambda v: v["constraint"].isin(*BLOCKING))
    shapeless = F.lit(False) if issues is None else F.size(issues) > 0
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "pending_review", 409).when(shapeless, 400).when(F.size(blocking) > 0, 422).otherwise(200)
    return joined.withColumns({"code": code, "blocking": blocking})


def same_value(a: Column, b: Column) -> Column:
    """Equal texts, or numbers of one value."""
    number = r"^-?[0-9]+(\.[0-9]+)?$"
    x, y = trim(a), trim(b)
    numeric = x.rlike(number) & y.rlike(number)
    return F.coalesce(a.eqNullSafe(b) | (numeric & (x.try_cast("decimal(38,10)") == y.try_cast("decimal(38,10)"))), F.lit(False))


def diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Both hold (doc_id, path, value). The rows that differ: doc_id, path, expected, actual."""
    e = expected.select("doc_id", "path", F.col("value").alias("expected"))
    a = actual.select("doc_id", "path", F.col("value").alias("actual"))
    return e.join(a, ["doc_id", "path"], "full_outer").where(~same_value(F.col("expected"), F.col("actual")))
