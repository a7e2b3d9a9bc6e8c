"""Writing products and state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import defaults as d
from gleanery.functions.ids import detail_shard
from gleanery.operators.reports import catalog_order, list_projection
from gleanery.scale import lookup_join


def stamped(df: DataFrame, version: str) -> DataFrame:
    """The one catalog version of a run on every product."""

    return df.withColumn("catalog_version", F.lit(version))


def write_details(jobs: DataFrame, path: str, version: str) -> None:
    """Full postings in folders by id shard (S21). Overwriting drops stale shards; readers of one id scan one folder."""

    stamped(jobs, version).withColumn("detail_shard", detail_shard("id")).write.partitionBy("detail_shard").mode("overwrite").parquet(path)


def write_list(jobs: DataFrame, path: str, version: str) -> None:
    """Narrow sorted list (S22). The sort is a range partitioning, so files follow the list order."""

    rows = list_projection(jobs.withColumn("detail_shard", detail_shard("id")))
    stamped(rows.orderBy(*catalog_order(), F.col("id").asc()), version).write.mode("overwrite").parquet(path)


def write_products(products: Mapping[str, DataFrame], root: str, version: str) -> None:
    """Campaigns, sources, companies and manifest under one version folder."""

    for name, df in products.items():
        stamped(df, version).write.mode("overwrite").parquet(f"{root}/{version}/{name}")


def write_state(tables: Mapping[str, DataFrame], root: str, version: str) -> None:
    """State tables of the next run in a new version folder: the folder being read is never overwritten."""

    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")


def refresh_sources(registry: DataFrame, published: DataFrame, source: str = "source_id", kept: Sequence[str] = ("job_count", "fetched_at", "health", "reason")) -> DataFrame:
    """Published source table brought up to the registry without fetching (S25). A changed or unpublishable status loses its health."""

    old = published.select(source, F.col("status").alias("_old_status"), *[F.col(c).alias(f"_p_{c}") for c in kept])
    joined = lookup_join(registry, old, source, "left")
    live = F.col("status").isin(*d.VERIFIED_STATUSES) & F.col("status").eqNullSafe(F.col("_old_status"))
    out = {c: F.when(live, F.col(f"_p_{c}")) for c in kept}
    if "health" in out:
        out["health"] = F.coalesce(out["health"], F.lit("not_ready"))
    if "reason" in out:
        out["reason"] = F.when(live, F.col("_p_reason")).when(~F.col("status").isin(*d.VERIFIED_STATUSES), F.concat(F.lit("status_"), F.lower("status")))
    return joined.select(*[c for c in registry.columns if c not in kept], *[v.alias(c) for c, v in out.items()])


def safe_cell(value: Column) -> Column:
    """A cell that would start a formula gets a quote mark in front."""

    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_rows(df: DataFrame) -> DataFrame:
    return df.select(*[safe_cell(F.col(c)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted; each file opens with a UTF-8 byte-order mark and the header."""

    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)

    def with_header(batches):
        yield pd.DataFrame({"value": pd.Series([header], dtype=object)})
        yield from batches

    lines = csv_rows(df).select(F.concat_ws(",", *quoted).alias("value"))
    lines.mapInPandas(with_header, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_backup(tables: Mapping[str, DataFrame], path: str) -> None:
    """Versioned backup of personal tables."""

    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_backup(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType | str], required: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """All tables of a backup, or an error before anything is replaced."""

    out = {}
    for name, schema in schemas.items():
        out[name] = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")
        missing = F.lit(False)
        for c in (required or {}).get(name, ()):
            missing = missing | F.col(c).isNull()
        if out[name].filter(missing).limit(1).count():
            raise ValueError(f"backup table {name} misses required values")
    return out


def upsert_job_states(states: DataFrame, patches: DataFrame, now: Column, keys: Sequence[str] = ("user_id", "job_id")) -> DataFrame:
    """One row per user and job: patched fields win, created time stays (S28). Several patches of a job: last one wins per field."""

    fields = [c for c in ("interest", "stage", "applied_at") if c in patches.columns]
    last = patches.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(f"_n_{c}") for c in fields])
    joined = states.join(last.withColumn("_touched", F.lit(True)), list(keys), "full_outer")
    touched = F.coalesce("_touched", F.lit(False))
    defaults = {"interest": "UNSET", "stage": "NOT_APPLIED"}
    out = [F.coalesce(F.col(f"_n_{c}"), F.col(c), F.lit(defaults.get(c))).alias(c) for c in fields]
    rest = [c for c in states.columns if c not in (*keys, *fields, "created_at", "updated_at")]
    return joined.select(*keys, *out, *rest, F.coalesce("created_at", now).alias("created_at"), F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"))


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Missing preference values filled on read."""

    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def toggle_done(events: DataFrame, toggles: DataFrame, now: Column, key: str = "event_id") -> DataFrame:
    """Flip completion of events with an odd number of toggles."""

    odd = toggles.groupBy(key).agg((F.count("*") % 2 == 1).alias("_flip"))
    flip = F.coalesce("_flip", F.lit(False))
    joined = events.join(odd, key, "left")
    done = F.when(flip, ~F.col("completed")).otherwise(F.col("completed"))
    stamp = F.when(flip, F.when(done, now)).otherwise(F.col("completed_at"))
    return joined.withColumn("completed_at", stamp).withColumn("completed", done).drop("_flip")


def without_rows(df: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows left after a deletion list."""

    return df.join(removed.select(*keys), list(keys), "left_anti")

