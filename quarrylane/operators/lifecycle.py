"""What happens to jobs between extraction and delivery: lists, scopes, review, inboxes, deliveries, second extractions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checks import format_kind
from ..functions.trees import entries
from .resolve import quick_search

FINISHED = ("done", "needs_review")


def wanted(
    status: str | None = None, types: Sequence[str] = (), formats: Sequence[str] = (), tenant: object = None, project: object = None, since: object = None, until: object = None, text: str | None = None,
    numbers: Sequence[str] = ("seller_inn", "buyer_inn", "inn"),
) -> Column:
    """The condition of a list of jobs (status, doc_type, mime, file_name, tenant, project, created_at, id and the columns of
    ``numbers``): every filter that is given holds; several types or formats are alternatives. A blank text is no filter."""
    on = F.lit(True)
    for column, value in (("status", status), ("tenant", tenant), ("project", project)):
        if value is not None:
            on &= F.col(column) == value
    if types:
        on &= F.col("doc_type").isin(*types)
    if formats:
        on &= format_kind(F.col("mime"), F.col("file_name")).isin(*formats)
    if since is not None:
        on &= F.col("created_at") >= F.lit(since)
    if until is not None:
        on &= F.col("created_at") <= F.lit(until)
    if text and text.strip():
        on &= quick_search(text.strip(), "file_name", "id", numbers)
    return on


def page(rows: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a list; ``order`` must be total, or pages may repeat rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def visible(rows: DataFrame, tenant: object = None, projects: Sequence[object] | None = None) -> DataFrame:
    """Rows that a user sees: all without a scope, a tenant's, or those of the user's projects. No projects: no rows, and
    nothing is read."""
    if projects is not None:
        rows = rows.where(F.col("project").isin(*projects) if projects else F.lit(False))
    return rows if tenant is None else rows.where(F.col("tenant") == tenant)


def review(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """The jobs (id, status, extracted, issues, corrected_at) after all actions (id, at, seq, action, extracted, reason), in
    the order of at and seq, ties by what the actions say:

    * ``approve`` makes a job in review done and sets corrected_at where it isn't set; on others it does nothing;
    * ``correct`` puts a new record in place, makes the job done and sets corrected_at; ``draft`` does so but for the status;
    * ``flag`` sends a finished job to review and appends its reason to the issues; on others it does nothing.

    A new record brings no issues along, so only flags after it count. Actions on unknown jobs are dropped; other actions
    do nothing. The states before each action come from running windows, which spill, not from a fold in memory."""
    known = actions.where(F.col("action").isin("approve", "correct", "draft", "flag"))
    t = known.withColumnRenamed("extracted", "new").join(jobs.select("id", F.col("status").alias("was")), "id")
    before = Window.partitionBy("id").orderBy("at", "seq", "action", "new", "reason").rowsBetween(Window.unboundedPreceding, -1)
    corrected = F.coalesce(F.max(F.col("action") == "correct").over(before), F.lit(False))
    t = t.withColumn("live", F.col("was").isin(*FINISHED) | corrected | (F.col("action") == "correct"))
    set_to = F.when(F.col("action") == "correct", "done").when(F.col("live") & (F.col("action") == "approve"), "done").when(F.col("live") & (F.col("action") == "flag"), "needs_review")
    t = t.withColumn("to", set_to)
    t = t.withColumn("from", F.coalesce(F.last("to", ignorenulls=True).over(before), "was"))
    place = F.struct("at", "seq", "action", "new", "reason")
    replaced = F.col("action").isin("correct", "draft")
    done = t.groupBy("id").agg(
        F.max_by("to", F.when(F.col("to").isNotNull(), place)).alias("to"),
        F.max(F.when(replaced, place)).alias("last"),
        F.max_by("new", F.when(replaced, place)).alias("new"),
        F.min(F.when((F.col("action") == "approve") & (F.col("from") == "needs_review"), F.col("at"))).alias("approved"),
        F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("action") == "flag"), place))).alias("flags"),
    )
    out = jobs.join(done, "id", "left")
    added = F.transform(F.filter("flags", lambda f: F.col("last").isNull() | (f > F.col("last"))), lambda f: f["reason"])
    own = F.when(F.col("last").isNull(), F.col("issues"))
    nothing = F.array().cast("array<string>")
    issues = F.when(F.size(added) > 0, F.concat(F.coalesce(own, nothing), added)).otherwise(own)
    return out.select(
        "id", F.coalesce("to", "status").alias("status"), F.when(F.col("last").isNotNull(), F.col("new")).otherwise(F.col("extracted")).alias("extracted"), issues.alias("issues"),
        F.coalesce("last.at", "corrected_at", "approved").alias("corrected_at"),
    )


def due_deliveries(jobs: DataFrame, now: Column, wait: str = "INTERVAL 5 MINUTES", attempts: int = 20, limit: int = 50) -> DataFrame:
    """Finished jobs (id, status, url, delivered_at, last_error, attempts, updated_at) whose delivery was tried and failed, fewer
    than ``attempts`` times and not within ``wait``, the longest untouched first."""
    due = F.col("url").isNotNull() & F.col("delivered_at").isNull() & F.col("last_error").isNotNull() & (F.col("attempts") < attempts) & F.col("status").isin(*FINISHED)
    return jobs.where(due & (F.col("updated_at") < now - F.expr(wait))).orderBy("updated_at", "id").limit(limit)


def pending_events(inbox: DataFrame, attempts: int = 10, limit: int = 50) -> DataFrame:
    """Events of an inbox (event_id, received_at, processed_at, attempts) that wait, the oldest first."""
    return inbox.where(F.col("processed_at").isNull() & (F.col("attempts") < attempts)).orderBy("received_at", "event_id").limit(limit)


def settle(inbox: DataFrame, results: DataFrame, now: Column, most: int = 500) -> DataFrame:
    """The inbox after a drain: ``results`` (event_id, error) mark events as processed and clear their error, or count an
    attempt more and keep the first ``most`` characters of the error. Several results of an event count as one, the
    failure if any."""
    r = results.groupBy("event_id").agg(F.lit(True).alias("_tried"), F.min("error").alias("_error"))
    t = inbox.join(r, "event_id", "left")
    failed, passed = F.col("_error").isNotNull(), F.col("_tried") & F.col("_error").isNull()
    out = {
        "processed_at": F.when(passed, now).otherwise(F.col("processed_at")),
        "attempts": F.col("attempts") + F.when(failed, 1).otherwise(0),
        "last_error": F.when(failed, F.substring("_error", 1, most)).when(~F.coalesce(passed, F.lit(False)), F.col("last_error")),
    }
    return t.select(*[out[c].alias(c) if c in out else F.col(c) for c in inbox.columns])


def merge_object(old: Column, new: Column) -> Column:
    """The JSON object ``old`` with the members of ``new``, whose values replace equal keys' whole, null ones too. A null, or
    what is no object, counts as an empty object; keys come sorted."""
    none = F.expr("CAST(map() AS map<string,variant>)")
    read = lambda x: F.coalesce(entries(F.try_parse_json(x)), none)
    both = F.struct(read(old).alias("old"), read(new).alias("new"))
    kept = lambda b: F.filter(F.map_entries(b["old"]), lambda e: ~F.array_contains(F.map_keys(b["new"]), e["key"]))
    member = lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null")))
    body = F.get(F.transform(F.array(both), lambda b: F.array_join(F.array_sort(F.transform(F.concat(kept(b), F.map_entries(b["new"])), member)), ",")), F.lit(0))
    return F.concat(F.lit("{"), body, F.lit("}"))


def second_plan(quality: Column, multipass: Column, by_model: Column, has_items: Column, table_rows: Column, fallback: Column, provider: Column) -> Column:
    """How a doubtful extraction is made again, from its ``quality`` (score, factors, again): ``multipass`` where a model
    extracted a type with items in one pass and the answer was cut, or empty although the text has rows; else ``retry``
    with another provider if the quality asks for it; else ``keep``."""
    has = lambda name: F.array_contains(quality["factors"], name)
    split = ~multipass & by_model & has_items & (has("truncated_json") | (has("empty_extract") & (table_rows > 0)))
    other = F.coalesce(F.nullif(fallback, F.lit("")) != F.coalesce(provider, F.lit("")), F.lit(False))
    return F.when(split, "multipass").when(quality["again"] & other, "retry").otherwise("keep")


def choose_extraction(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` (id, plan, quality, n_missing, extracted) with ``chosen`` (first or second), the record and quality of the choice, and
    ``factors``, the doubts that stay with the job.

    ``second`` (id, quality, n_missing, extracted) holds what the second extractions gave; one that failed has no row. It wins by a
    lower score, or an equal one with fewer fields missing. Doubts of a job that wasn't tried again stay only if its
    quality asked for that. Rows of ``second`` for jobs that keep their first extraction are ignored."""
    s = second.select("id", F.struct("quality", "n_missing", "extracted").alias("s"))
    t = first.join(s, "id", "left")
    a, b = F.col("quality.score"), F.col("s.quality.score")
    better = (F.col("plan") != "keep") & F.col("s").isNotNull() & ((b < a) | ((b == a) & (F.col("s.n_missing") < F.col("n_missing"))))
    t = t.withColumn("_second", F.coalesce(better, F.lit(False)))
    of = lambda c: F.when(F.col("_second"), F.col(f"s.{c}")).otherwise(F.col(c))
    factors = F.when((F.col("plan") != "keep") | F.col("quality.again"), of("quality")["factors"]).otherwise(F.array().cast("array<string>"))
    return t.select("id", "plan", F.when(F.col("_second"), "second").otherwise("first").alias("chosen"), of("quality").alias("quality"), of("n_missing").alias("n_missing"), of("extracted").alias("extracted"), factors.alias("factors"))


#: Notes of a parser that mean lost rows.
LOST_ROWS = "^multipass_(chunks_truncated|chunk_failed)"


def outcome(
    issues: Column, factors: Column, notes: Column, n_fields: Column, skipped: Column, checked: Column, doc_type: Column, class_confidence: Column, hinted: Column, low_confidence: Column, table_rows: Column,
    review_below: float = 0.5, most_rows: int = 400,
) -> Column:
    """status, issues and deferred of a job at its end. Its issues are those of validation, the doubts of its extraction, the
    parser's notes about lost rows, ``extract_empty`` where an extraction that nobody ``checked`` ran and found nothing,
    ``classify_uncertain`` for a type that no one gave by hand and that is missing or unsure, and
    ``complex_document_deferred`` above ``most_rows`` table rows. Any of them, or a low confidence, sends it to review."""
    none = F.array().cast("array<string>")
    deferred = table_rows > most_rows
    unsure = ~hinted & (doc_type.isNull() | (F.coalesce(class_confidence, F.lit(1.0)) < review_below))
    marks = F.array_compact(F.array(F.when((n_fields == 0) & ~skipped & ~checked, "extract_empty"), F.when(unsure, "classify_uncertain"), F.when(deferred, "complex_document_deferred")))
    lost = F.filter(F.coalesce(notes, none), lambda n: n.rlike(LOST_ROWS))
    every = F.concat(F.coalesce(issues, none), F.coalesce(factors, none), lost, marks)
    status = lambda x: F.when((F.size(x) > 0) | low_confidence, "needs_review").otherwise("done")
    return F.get(F.transform(F.array(every), lambda x: F.struct(status(x).alias("status"), x.alias("issues"), deferred.alias("deferred"))), F.lit(0))
