"""Job tables: lookups, inserts, retries and reclaims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_if_absent(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with those new rows whose keys it lacks; of new rows with equal keys the first by all columns."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in new.columns])
    first = new.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return table.unionByName(first.join(table.select(*keys), list(keys), "left_anti").select(table.columns))


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first by ``order`` (an idempotency key replays the row it made)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def replay(requests: DataFrame, tenant: str = "tenant", key: str = "key") -> DataFrame:
    """Requests (id, tenant, key, at) with ``job``: the id of the first request of the same tenant and key; requests without
    key are their own."""
    w = Window.partitionBy(tenant, key).orderBy("at", "id")
    keyed = requests.where(F.col(key).isNotNull()).withColumn("job", F.first("id").over(w))
    return keyed.unionByName(requests.where(F.col(key).isNull()).withColumn("job", F.col("id")))


def backoff_seconds(attempts: Column, first: int = 1, most: int = 60) -> Column:
    """Seconds before the next try: doubling from ``first``, ``most`` at most."""
    return F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), attempts - 1))


def queue_state(tries: DataFrame, attempts: int = 3, delay: int = 5) -> DataFrame:
    """job, state, n, due of tries (job, at, ok): done once one succeeded, failed after ``attempts``, else waiting until the
    last try plus an exponential delay of ``delay`` seconds."""
    t = tries.groupBy("job").agg(F.bool_or("ok").alias("ok"), F.count("*").alias("n"), F.max("at").alias("last"))
    state = F.when(F.col("ok"), "done").when(F.col("n") >= attempts, "failed").otherwise("waiting")
    due = F.timestamp_seconds(F.unix_timestamp("last") + backoff_seconds(F.col("n"), delay, 1 << 30).cast("long"))
    return t.select("job", state.alias("state"), "n", F.when(state == "waiting", due).alias("due"))


def reclaim(stuck: DataFrame, most: int = 3) -> DataFrame:
    """Stuck jobs (id, reclaims) with one reclaim more; beyond ``most`` they are put off instead of run again."""
    n = F.coalesce("reclaims", F.lit(0)) + 1
    return stuck.select("id", n.alias("reclaims"), (n > most).alias("stalled"), F.when(n > most, "needs_review").otherwise("pending").alias("status"))


def not_found(rows: DataFrame, policy: Column) -> DataFrame:
    """What becomes of items without an entry: ``ignore`` drops them, ``flag`` sends the job to review, ``create`` makes a
    draft entry of the name; found items pass."""
    miss = F.col("entry_id").isNull()
    action = F.when(~miss, "matched").when(policy == "create", "draft").when(policy == "flag", "review").otherwise("ignored")
    return rows.withColumn("action", action).withColumn("draft_name", F.when(action == "draft", F.col("name"))).where("action <> 'ignored'")


def enrich(rows: DataFrame, registry: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with the registry's fields where they have none of their own; ``enriched`` names those filled."""
    side = registry.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in fields])
    t = rows.join(side, key, "left")
    gap = {c: (F.coalesce(F.col(c), F.lit("")) == "") & F.col(f"_{c}").isNotNull() for c in fields}
    t = t.withColumn("enriched", F.array_compact(F.array(*[F.when(gap[c], F.lit(c)) for c in fields])))
    return t.withColumns({c: F.when(F.col(f"_{c}").isNotNull() & (F.coalesce(F.col(c), F.lit("")) == ""), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}).drop(*[f"_{c}" for c in fields])
