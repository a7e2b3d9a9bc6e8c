"""Snapshots and keyed state, batch form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.scale import keep_first, lag_rows, lookup_join, rank_rows, streak_rows


def snapshot_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Each key's change: added, removed, changed or same. Both sides hold one row per key."""

    old = previous.select(*keys, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    new = current.select(*keys, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed").otherwise("same")
    )
    return old.join(new, list(keys), "full_outer").select(*keys, change.alias("change"))


def advance_lifecycle(
    previous: DataFrame,
    current: DataFrame,
    sources: DataFrame,
    now: Column,
    source: str = "source_id",
    key: str = "id",
    close_after: int = 2,
) -> DataFrame:
    """Move the posting table one snapshot on.

    ``sources`` holds (source, complete, quarantined) of this run. A complete snapshot carries first-seen and change
    times over, counts a miss for every absent row and closes it at ``close_after``. An incomplete or quarantined one
    keeps the old rows untouched, or takes the new rows when there were none. Both inputs hold one row per (source, key).
    """

    names = previous.columns
    held = previous.groupBy(source).agg(F.lit(True).alias("_has_old"))
    flags = sources.select(source, "complete", "quarantined").join(held, source, "full_outer")
    flags = flags.select(
        source,
        (~F.coalesce("complete", F.lit(False)) | F.coalesce("quarantined", F.lit(False))).alias("_keep"),
        F.coalesce("_has_old", F.lit(False)).alias("_has_old"),
    )
    old = previous.select(source, key, F.struct(*names).alias("_o"))
    new = current.select(source, key, F.struct(*names).alias("_c"))
    both = lookup_join(old.join(new, [source, key], "full_outer"), flags, source, "left")
    o, c = F.col("_o"), F.col("_c")
    keep = F.coalesce("_keep", F.lit(True))

    def row(base: Column, **changes: Column) -> Column:
        return F.struct(*[changes.get(n, base[n]).alias(n) for n in names])

    hash_changed = ~o["content_hash"].eqNullSafe(c["content_hash"])
    renewed = row(
        c, first_seen_at=o["first_seen_at"], changed_at=F.when(hash_changed, now).otherwise(o["changed_at"]),
        first_missing_successes=F.lit(0).cast(previous.schema["first_missing_successes"].dataType),
    )
    misses = o["first_missing_successes"] + 1
    missed = row(o, first_missing_successes=misses, status=F.when(misses >= close_after, "CLOSED").otherwise(o["status"]))
    result = (
        F.when(keep & F.coalesce("_has_old", F.lit(False)), o)
        .when(keep, c)
        .when(o.isNull(), c)
        .when(c.isNull(), missed)
        .otherwise(renewed)
    )
    return both.select(result.alias("_r")).filter("_r is not null").select("_r.*")


def retain(df: DataFrame, now: Column, days: int = 90, status: str = "status", seen: str = "last_verified_at") -> DataFrame:
    """Drop closed rows not seen for ``days``."""

    return df.filter((F.col(status) != "CLOSED") | (F.col(seen) >= now - F.expr(f"INTERVAL {days} DAYS")))


def reuse_unmodified(log: DataFrame, previous: DataFrame, source: str = "source_id") -> DataFrame:
    """Fetch log with not-modified runs settled (T3): with old rows they count as complete and reuse them; without, the
    source is stale and the run incomplete."""

    held = previous.groupBy(source).agg(F.count("*").alias("previous_rows"))
    joined = lookup_join(log, held, source, "left")
    lost = F.col("not_modified") & F.col("previous_rows").isNull()
    return (
        joined.withColumn("reuse_previous", F.col("not_modified") & F.col("previous_rows").isNotNull())
        .withColumn("complete", F.col("complete") & ~lost)
        .withColumn("health", F.when(lost, "stale").otherwise(F.col("health")))
        .withColumn("reason", F.when(lost, "not_modified_without_previous_snapshot").otherwise(F.col("reason")))
        .drop("previous_rows")
    )


def current_or_previous(current: DataFrame, previous: DataFrame, log: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows to treat as the current snapshot: the old ones for reused sources, the fetched ones for the rest."""

    reused = log.filter("reuse_previous").select(source).distinct()
    return lookup_join(current, reused, source, "left_anti").unionByName(lookup_join(previous, reused, source, "left_semi"))


def merge_validators(old: DataFrame, new: DataFrame, source: str = "source_id",
                     skip_health: Sequence[str] = ("not_ready", "blocked", "error")) -> DataFrame:
    """Cache validators after a run: new values over old, runs that failed leave the old ones."""

    names = [c for c in old.columns if c != source]
    fresh = new.filter(~F.col("health").isin(*skip_health)).select(source, *[F.col(c).alias(f"_n_{c}") for c in names])
    return old.join(fresh, source, "full_outer").select(source, *[F.coalesce(f"_n_{c}", c).alias(c) for c in names])


def clean_history(history: Column, keep: int = 6) -> Column:
    """Last non-negative whole numbers of a stored history."""

    numbers = F.filter(F.transform(history, lambda x: x.try_cast("bigint")), lambda x: x >= 0)
    return last_items(numbers, keep)


def last_items(items: Column, keep: int) -> Column:
    """Last ``keep`` items; shorter lists are kept whole."""

    return F.slice(items, F.greatest(F.size(items) - keep + 1, F.lit(1)), keep)


def push_history(history: Column, count: Column, complete: Column, not_modified: Column, keep: int = 6) -> Column:
    """Ring of the last counts, moved only by complete and modified runs (T4)."""

    base = F.coalesce(history, F.array().cast("array<bigint>"))
    return F.when(complete & ~not_modified, last_items(F.concat(base, F.array(count.cast("bigint"))), keep)).otherwise(base)


def recent_counts(runs: DataFrame, source: Sequence[str], run: str, count: str, look_back: int = 3) -> DataFrame:
    """Counts of the runs before each run (W7). Input is already one row per (source, run)."""

    frame = Window.partitionBy(*source).orderBy(run).rowsBetween(-look_back, -1)
    return runs.withColumn("recent", F.collect_list(count).over(frame))


def failure_streak(log: DataFrame, key: Sequence[str], order: Sequence[Column], success: Column) -> DataFrame:
    """Consecutive failures at every row, reset by a success."""

    return streak_rows(log, order, key, success, "consecutive_failures")


def merge_observations(previous: DataFrame, observed: DataFrame, stale_after: int = 3, key: str = "company_id",
                       cohort: str = d.COHORT) -> DataFrame:
    """Entry state after one probe run (T2, J23). Both inputs hold one row per key and the same columns."""

    names = previous.columns
    joined = previous.select(key, F.struct(*names).alias("_o")).join(
        observed.select(key, F.struct(*[c for c in observed.columns]).alias("_n")), key, "full_outer")
    o, n = F.col("_o"), F.col("_n")
    status = F.coalesce(n["directory_status"], F.lit("STALE"))
    failures = F.coalesce(o["consecutive_failures"], F.lit(0)) + 1
    confirmed, lost = status == "ACTIVE_CONFIRMED", status.isin("BLOCKED", "STALE") & o.isNotNull()
    checked = F.coalesce(n["checked_at"], o["last_checked_at"])
    same = lambda **changes: F.struct(*[changes.get(c, o[c]).alias(c) for c in names])
    url = F.coalesce(n["career_url"], o["career_url"])
    result = (
        F.when(n.isNull(), o)
        .when(confirmed, same(
            **{key: F.col(key)}, cohort=F.coalesce(n["cohort"], F.lit(cohort)), directory_status=status,
            entry_type=F.coalesce(n["entry_type"], F.lit("OFFICIAL_CAREER_SITE")), career_url=url,
            evidence_url=F.coalesce(n["career_url"], o["evidence_url"]), signals=n["signals"], last_checked_at=checked,
            first_confirmed_at=F.coalesce(o["first_confirmed_at"], n["checked_at"]), consecutive_failures=F.lit(0),
            public=F.lit(True)))
        .when(lost, same(
            directory_status=F.when(failures < stale_after, "STALE").otherwise("INACTIVE"), last_checked_at=checked,
            consecutive_failures=failures, last_error_type=n["error_type"], public=F.lit(False)))
        .otherwise(same(
            **{key: F.col(key)}, cohort=F.coalesce(n["cohort"], F.lit(cohort)), directory_status=status, career_url=url,
            last_checked_at=checked, consecutive_failures=failures, last_error_type=n["error_type"], public=F.lit(False)))
    )
    return joined.select(result.alias("_r")).select("_r.*")


def remaining_work(candidates: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Candidates not yet processed."""

    return candidates.join(processed.select(key), key, "left_anti")


def merge_processed(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Processed rows, newer results first."""

    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return keep_first(both, keys, [F.col("_batch").desc(), *[F.col(c).asc() for c in seq]]).drop("_batch")


def saturation(runs: DataFrame, run: str, added: str, cycles: int = 2) -> DataFrame:
    """Runs after which ``cycles`` runs in a row brought nothing new (T8). One row per run."""

    ranked = rank_rows(runs, [F.col(run).asc()], rank="_place")
    reach = ranked.select(F.explode(F.sequence(F.col("_place"), F.col("_place") + cycles - 1)).alias("_place"), F.col(added).alias("_added"))
    seen = reach.groupBy("_place").agg(F.sum("_added").alias("_sum"), F.count("*").alias("_runs"))
    quiet = (F.col("_sum") == 0) & (F.col("_runs") == cycles)
    return ranked.join(seen, "_place").withColumn("saturated", quiet).select(*runs.columns, "saturated")


def stage_events(log: DataFrame, keys: Sequence[str], order: Sequence[Column], stage: str = "stage",
                 types: dict[str, str] | None = None) -> DataFrame:
    """Typed events where a row's stage differs from the one before."""

    types = types or d.STAGE_EVENTS
    with_before = lag_rows(log, order, keys, stage, "previous_stage")
    changed = with_before.filter(~F.col(stage).eqNullSafe(F.col("previous_stage")))
    event = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return changed.withColumn("event_type", F.try_element_at(event, F.col(stage))).filter("event_type is not null")


def applied_at(log: DataFrame, keys: Sequence[str], stamp: str, stage: str = "stage") -> DataFrame:
    """First time a job left the not-applied stages."""

    counted = F.when(~F.col(stage).isin("NOT_APPLIED", "WITHDRAWN"), F.col(stamp))
    return log.groupBy(*keys).agg(F.min(counted).alias("applied_at"))
