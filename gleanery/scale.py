"""Building blocks that keep hot keys, large lookups and global order distributed."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20
TASK_ROWS = 250_000
SALTS = 16
LOOKUP_JOINS = ("inner", "left", "left_semi", "left_anti")
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a temporary one only in local mode."""

    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")


def materialize(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder so later reads see the same rows and order."""

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_bounded(df: DataFrame, limit: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when the frame is proven to hold at most ``limit`` rows of at most ``max_bytes`` in all (reads no further than that)."""

    width = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) if _as_text(f.dataType) else F.lit(16) for f in df.schema.fields), F.lit(0))
    seen = df.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("size")).first()
    return seen["n"] <= limit and (seen["size"] or 0) <= max_bytes


def _as_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.ArrayType, T.MapType, T.StructType, T.VariantType))


def lookup_join(facts: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "left", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join facts to a lookup with one row per key; both ways give the same rows.

    A lookup proven small, in rows and bytes, is broadcast. A larger one is shuffled, and the facts of a hot key are split over tasks
    by the engine's skew join, which may split the facts' side in all the joins allowed here.
    """

    if how not in LOOKUP_JOINS:
        raise ValueError(f"{how} is no lookup join; use one of {', '.join(LOOKUP_JOINS)}")
    keys = [on] if isinstance(on, str) else list(on)
    return facts.join(F.broadcast(lookup) if is_bounded(lookup, max_rows) else lookup, keys, how)


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, however often later filters and projections name them.

    The values pass a one-element explode, through which the optimizer doesn't copy expressions.
    """

    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_computed")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select("*", held).select(*kept, "_computed.*")


def bit_set(df: DataFrame, mark: str, bits: int) -> bytes:
    """The marks (whole numbers under ``bits``) as a set of bits, of that size whatever the number of rows."""

    words = df.select(F.shiftright(mark, 6).alias("word"), F.expr(f"shiftleft(1L, cast({mark} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toPandas()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.tobytes()


def dealt(df: DataFrame, tasks: int | None) -> DataFrame:
    """The rows dealt to ``tasks`` partitions, for costly row work on few input splits; as they are without it."""

    return df.repartition(tasks) if tasks else df


def dealt_by_rows(df: DataFrame, keys: Sequence[str] = (), rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt (by ``keys``) to at least as many partitions as keep each at about ``rows`` rows, so a task's share doesn't grow
    with the table. For frames that are cheap to count: a count of a stored table reads its footers only.
    """

    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *[F.col(k) for k in keys])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tasks: int | None = None) -> DataFrame:
    """One row per key by a total order.

    ``row_number() = 1`` lets Spark drop the losers before the shuffle (WindowGroupLimit), so a hot key
    sends one row per input task. With ``tasks``, rows are dealt to as many partitions, which Spark doesn't merge: wide rows that pack
    well would else meet in a few tasks. A key's rows are then thinned to SALTS first.
    """

    if tasks:
        salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).repartition(tasks, *keys, "_salt")
        df = top_per_group(salted, [*keys, "_salt"], order, 1).drop("_rn", "_salt").repartition(tasks, *keys)
    return top_per_group(df, keys, order, 1).drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rn") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def _place(df: DataFrame, order: Sequence[Column], group: Sequence[str]) -> DataFrame:
    """Rows spread by range of (group, order), sorted, with partition ``_part`` and place ``_idx`` fixed by a checkpoint.

    A hot group spans several partitions, so no step that follows puts a whole group into one task.
    """

    keys = [F.col(c).asc_nulls_first() for c in group] + list(order)
    placed = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    return (
        placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
        .withColumn("_idx", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_at")
    )


def _join_runs(placed: DataFrame, runs: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows with the values of their run. Runs are few, one per partition and group; proven small they are broadcast, so rows stay where they are."""

    right = runs.select(F.col("_part").alias("_rpart"), *[F.col(c).alias(f"_r_{c}") for c in group], *values)
    right = materialize(right)
    if is_bounded(right):
        right = F.broadcast(right)
    match = F.col("_part") == F.col("_rpart")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return placed.join(right, match)


def rank_rows(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    rank: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """Exact 1..n rank in the whole table, or within each group, without one task per group.

    The counts of the (partition, group) runs are added up over the few partitions a group spans, and each row adds
    its own place in its run. ``size`` also adds the number of rows of the group.
    """

    placed = _place(df, order, group)
    runs = placed.groupBy("_part", *group).agg(F.min("_idx").alias("_first"), F.count("*").alias("_n"))
    span = Window.partitionBy(*group)  # one row per partition a group touches
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(span.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size:
        runs = runs.withColumn(size, F.sum("_n").over(span))
    extra = [size] if size else []
    value = (F.col("_idx") - F.col("_first") + F.col("_before") + 1).alias(rank)
    return _join_runs(placed, runs, group, ["_first", "_before", *extra]).select(*df.columns, value, *extra)


def lag_rows(df: DataFrame, order: Sequence[Column], group: Sequence[str], column: str, name: str) -> DataFrame:
    """Value of the row before in the group; the first row of a run takes it from the run before."""

    placed = _place(df, order, group)
    local = Window.partitionBy("_part", *group).orderBy("_idx")
    placed = placed.withColumn("_prev", F.lag(F.struct(column)).over(local))
    runs = placed.groupBy("_part", *group).agg(F.max_by(F.struct(column), F.col("_idx")).alias("_last"))
    runs = runs.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy("_part")))
    value = F.coalesce(F.col("_prev"), F.col("_carry"))[column].alias(name)
    return _join_runs(placed, runs, group, ["_carry"]).select(*df.columns, value)


def streak_rows(df: DataFrame, order: Sequence[Column], group: Sequence[str], is_break: Column, name: str) -> DataFrame:
    """Number of rows since the last break in the group (0 on a break)."""

    placed = _place(df.withColumn("_break", F.coalesce(is_break, F.lit(False))), order, group)
    local = Window.partitionBy("_part", *group).orderBy("_idx")
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_rn", F.row_number().over(local)).withColumn("_hit", F.max(F.when(F.col("_break"), F.col("_rn"))).over(upto))
    runs = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.max("_hit").alias("_last_hit"))
    back = Window.partitionBy(*group).orderBy("_part")
    earlier = back.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_end", F.sum("_n").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.withColumn("_start", F.col("_end") - F.col("_n"))
    # place in the group of the last break in earlier runs
    runs = runs.withColumn("_carry_hit", F.coalesce(F.max(F.col("_start") + F.col("_last_hit")).over(earlier), F.lit(0)))
    value = (F.col("_start") + F.col("_rn") - F.coalesce(F.col("_start") + F.col("_hit"), F.col("_carry_hit"))).alias(name)
    return _join_runs(placed, runs, group, ["_start", "_carry_hit"]).select(*df.columns, value)


def collect_in_chunks(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], chunk: int = 1000, name: str = "values"
) -> DataFrame:
    """Ordered lists per key, cut into rows of at most ``chunk`` items: whole, yet no row grows with the key."""

    ranked = rank_rows(df.select(*keys, value, *[c.alias(f"_o{i}") for i, c in enumerate(_plain(order))]),
                       [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))], keys, "_pos")
    ranked = ranked.withColumn("chunk_no", F.floor((F.col("_pos") - 1) / chunk))
    packed = ranked.groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list(F.struct("_pos", value))).alias("_packed"))
    return packed.select(*keys, "chunk_no", F.transform("_packed", lambda item: item[value]).alias(name))


def _plain(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]
