"""Operational metrics over job rows: id, created_at, status, doc_type, engine, latency, confidence, caller, extracted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Widths in minutes that a chart's buckets may have.
STEPS = (5, 10, 15, 30, 60, 120, 180, 360, 720, 1440, 2880, 5760, 10080)
TERMINAL = ("done", "needs_review", "failed")


def bucket_minutes(hours: float) -> int:
    """The first step that shows ``hours`` in 28 buckets or fewer."""
    least = max(5.0, hours * 60 / 28)
    return next((s for s in STEPS if s >= least), STEPS[-1])


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], nearest: bool = False, splits: int = 64) -> DataFrame:
    """The keys (which hold no nulls) and for each share the exact percentile of a value: between the two nearest values, or
    with ``nearest`` the least value that so large a share of the rows doesn't exceed. Nulls don't count; keys without a value
    have no row.

    Equal values are counted first. Approximate percentiles of a key's distinct values, of a fixed size, cut these into
    ``splits`` ranges; sums of the ranges say in which one a wanted rank lies, and only those ranges are sorted, each apart. So
    no buffer holds a key's values, and a key that most rows have is sorted by many tasks."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = F.percentile_approx("_v", [i / splits for i in range(1, splits)], 1000).alias("_cuts")
    if keys:
        cut = counted.join(counted.groupBy(*keys).agg(cuts), list(keys))
    else:
        cut = counted.crossJoin(F.broadcast(counted.agg(cuts)))  # one row
    ranged = cut.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"))
    by = Window.partitionBy(*keys)  # at most ``splits`` rows of a key
    sums = sums.withColumn("_to", F.sum("_n").over(by.orderBy("_part"))).withColumn("_all", F.sum("_n").over(by))

    def ranks(name: str, p: float) -> list[Column]:
        at = F.greatest(F.ceil(p * F.col("_all")) - 1, F.lit(0)).cast("double") if nearest else p * (F.col("_all") - 1)
        one = lambda rank, weight: F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"), weight.alias("weight"))
        return [one(F.floor(at), 1 - (at - F.floor(at))), one(F.floor(at) + 1, at - F.floor(at))]

    wanted = sums.withColumn("_w", F.explode(F.array(*[r for n, p in shares.items() for r in ranks(n, p)])))
    wanted = wanted.where((F.col("_w.weight") > 0) & (F.col("_w.rank") < F.col("_to")) & (F.col("_w.rank") >= F.col("_to") - F.col("_n")))
    wanted = wanted.select(*keys, "_part", (F.col("_to") - F.col("_n")).alias("_before"), "_w")
    here = [*keys, "_part"]
    within = Window.partitionBy(*here).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = ranged.join(wanted.select(*here).distinct(), here, "left_semi").withColumn("_upto", F.sum("_c").over(within))
    rank = F.col("_w.rank") - F.col("_before")
    found = sorted_.join(wanted, here).where((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")))
    term = lambda n: F.sum(F.when(F.col("_w.name") == n, F.col("_v") * F.col("_w.weight"))).alias(n)
    return found.groupBy(*keys).agg(*[term(n) for n in shares])


def _measured(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by status, average confidence and latency percentiles, for each key."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    done = F.col("status").isin("done", "needs_review")
    counts = jobs.groupBy(*keys).agg(F.count("*").alias("total"), *map(count, ("done", "needs_review", "failed", "pending", "processing")), F.avg(F.when(done, F.col("confidence"))).alias("avg_confidence"))
    shares = exact_percentiles(jobs.where(done), keys, "latency", {"p50": 0.5, "p95": 0.95})
    out = counts.join(shares, list(keys), "left") if keys else counts.join(F.broadcast(shares), F.lit(True), "left")  # one row
    return out.select(*keys, "total", *[f"n_{s}" for s in ("done", "needs_review", "failed", "pending", "processing")], "p50", "p95", "avg_confidence")


def summary(jobs: DataFrame, hours: int) -> DataFrame:
    """One row: counts by status, latency percentiles, rates (0 without jobs) and jobs an hour."""
    one = _measured(jobs, [])
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return one.withColumns({"success_rate": rate("n_done"), "failure_rate": rate("n_failed"), "review_rate": rate("n_needs_review"), "per_hour": F.floor(F.col("total") / hours * 100 + 0.5) / 100})


def breakdown(jobs: DataFrame, key: Column, unknown: str) -> DataFrame:
    """The same counts for each key; null and empty keys under ``unknown``."""
    named = F.when(key.isNull() | (key == ""), F.lit(unknown)).otherwise(key)
    return _measured(jobs.withColumn("key", named), ["key"])


def time_series(jobs: DataFrame, since: Column, until: Column, minutes: int) -> DataFrame:
    """A row for each epoch-aligned bucket from ``since`` to ``until`` (columns of one row), empty ones included."""
    step = minutes * 60
    at = lambda ts: F.floor(F.unix_seconds(ts) / step) * step
    bounds = jobs.agg(at(since).alias("a"), at(until).alias("b"))
    grid = bounds.select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("bucket"))
    timed = jobs.withColumn("bucket", at(F.col("created_at"))).where("bucket IS NOT NULL")
    own = timed.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    own = own.join(exact_percentiles(timed, ["bucket"], "latency", {"p95": 0.95}), "bucket", "left")
    return grid.join(own, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("failed", F.lit(0)).alias("failed"), "p95")


def coverage(jobs: DataFrame, paths: Sequence[str], column: str = "extracted") -> DataFrame:
    """field, filled, total: rows whose JSON holds a value at the path, over the finished rows. One pass for all paths."""
    filled = [F.count_if(F.coalesce(F.get_json_object(column, f"$.{p}"), F.lit("")) != "").alias(f"f{i}") for i, p in enumerate(paths)]
    one = jobs.agg(F.count_if(F.col("status").isin("done", "needs_review")).alias("total"), *filled)
    pairs = ", ".join(f"'{p}', f{i}" for i, p in enumerate(paths))
    return one.select("total", F.expr(f"stack({len(paths)}, {pairs}) as (field, filled)")).select("field", "filled", "total")


def usage_rollup(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.count("*").alias("calls"), F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"))


def quota(log: DataFrame, connectors: DataFrame, budgets: DataFrame, day: Column) -> DataFrame:
    """caller, connector, used, cap and the reason of a refusal, the first that applies; null: allowed."""
    used = log.where((F.to_date("started_at") == day) & (F.col("status") == "success")).groupBy("caller", "connector").agg(F.sum("units").alias("used"))
    t = used.join(connectors, "connector", "left").join(budgets, ["caller", "connector"], "left")
    cap = F.least("daily_cap", "daily_budget")
    reason = F.when(F.col("enabled").isNull(), "unknown_connector").when(~F.col("enabled"), "connector_disabled").when(F.col("budget_enabled") == F.lit(False), "consumer_disabled").when(cap.isNull(), "no_cap").when(F.col("used") >= cap, "quota_exceeded")
    return t.select("caller", "connector", "used", cap.alias("cap"), reason.alias("reason"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last by ``order`` (upsert, latest wins)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def content_duplicates(jobs: DataFrame, hours: int = 24) -> DataFrame:
    """id, source_id: the newest finished job of the same content and owner that a job within ``hours`` could reuse, of equal
    times the larger id.

    Time is cut into spans of ``hours``, so such a job lies in the same span or the one before: a running maximum in the
    former, the latter's last finished job joined in. The work is linear in copies, and a content with many is spread over
    its spans. Jobs without owner or content reuse none."""
    known = jobs.where("owner IS NOT NULL AND sha IS NOT NULL AND created_at IS NOT NULL")
    t = known.select("id", "owner", "sha", F.unix_micros("created_at").alias("_t"), F.when(F.col("status") == "done", F.struct(F.unix_micros("created_at").alias("t"), "id")).alias("_done"))
    span = hours * 3_600_000_000
    t = t.withColumn("_span", F.floor(F.col("_t") / span))
    earlier = Window.partitionBy("owner", "sha", "_span").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    last = t.where("_done IS NOT NULL").groupBy("owner", "sha", (F.col("_span") + 1).alias("_span")).agg(F.max("_done").alias("_last"))
    near = t.withColumn("_own", F.max("_done").over(earlier)).join(last, ["owner", "sha", "_span"], "left")
    source = F.coalesce("_own", F.when(F.col("_last.t") > F.col("_t") - span, F.col("_last")))
    return near.select("id", source["id"].alias("source_id")).where("source_id IS NOT NULL")


def stale(jobs: DataFrame, status: str, before: Column, limit: int) -> DataFrame:
    return jobs.where((F.col("status") == status) & (F.col("created_at") < before)).orderBy("created_at", "id").limit(limit)


def operational(jobs: DataFrame, keys: Sequence[str] = (), hours: float | None = None) -> DataFrame:
    """The whole summary of jobs (status, latency, confidence, issues, tokens_in, tokens_out, model_ms, used_model), for each key if there are
    any: counts by status, jobs with issues and with a model's call, their rates (0 without jobs), percentiles of latency,
    tokens and the model's time, average confidence of the finished ones and, with ``hours``, jobs an hour to a hundredth.

    Latency and the measures of a call count wherever they are known. Keys must hold no nulls. Each measure's percentiles are found
    apart (``exact_percentiles``), so no group's values come together in one buffer."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    names = ("done", "needs_review", "failed", "pending", "processing")
    out = jobs.groupBy(*keys).agg(
        F.count("*").alias("total"), *map(count, names), F.count_if(F.size(F.coalesce("issues", F.array().cast("array<string>"))) > 0).alias("with_issues"), F.count_if(F.col("used_model")).alias("with_model"),
        F.avg(F.when(F.col("status").isin("done", "needs_review"), F.col("confidence"))).alias("avg_confidence"),
    )
    for value, shares in (("latency", {"p50": 0.5, "p95": 0.95}), ("tokens_in", {"tokens_in_p95": 0.95}), ("tokens_out", {"tokens_out_p95": 0.95}), ("model_ms", {"model_ms_p95": 0.95})):
        found = exact_percentiles(jobs, keys, value, shares)
        out = out.join(found, list(keys), "left") if keys else out.join(F.broadcast(found), F.lit(True), "left")  # one row
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    rates = {"done_rate": "n_done", "review_rate": "n_needs_review", "failed_rate": "n_failed", "issue_rate": "with_issues", "model_rate": "with_model"}
    out = out.withColumns({name: rate(c) for name, c in rates.items()})
    return out if hours is None else out.withColumn("per_hour", F.floor(F.col("total") / hours * 100 + 0.5) / 100)
