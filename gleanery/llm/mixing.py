"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order fixed by hash, are cut into blocks of ``block`` documents. A source of weight w (its share of the
mixture) is a task of one-slot jobs: block j (from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w). One block runs
per slot: of those released, the one with the earliest deadline (ties: larger weight, then source name). The weights add up to 1, so on
a single lane earliest-deadline-first meets every deadline, and after any number of slots each source is less than one block away from
its share.

Weights are rounded to whole slots of a period of ``period`` slots, with at least one slot each (``period`` grows with the number of
sources if need be). Windows repeat with the period, so the schedule of one period is the schedule of all: block j of a source with a
slots per period takes the slot of job j mod a in period j div a. Only that table is computed in one place; its size is the period's, and
documents find their slots by a join. When the first source runs out, the phase ends with that period, and the rest is scheduled with
renewed weights; idle slots of sources that ended are left out. Every document gets exactly one place.

Only counts per source come to the driver: one row per source. Null sources form one source of their own. Equal documents are told apart
by nothing and take neighbouring places. An empty table gives an empty result. Input columns named like a new column are replaced.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, PERIOD, ALPHA, BUCKET = 64, 1000, 0.5, 10_000
MAX_BROADCAST = 200_000  # rows of the schedule table; beyond it the joins shuffle


def slots_per_period(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots by largest remainder, at least one each, that add up to the period."""
    period = max(period, len(weights))
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    slots = {s: 1 + int(x) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s))
    for s in order[: period - sum(slots.values())]:
        slots[s] += 1
    return slots


def pfair_period(slots: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, job, slot, release, deadline) of one period, earliest deadline first among released jobs."""
    period = sum(slots.values())
    weight = {s: Fraction(a, period) for s, a in slots.items()}
    jobs = sorted((int(j / weight[s]), -int(-(j + 1) / weight[s] // 1), s, j) for s, a in slots.items() for j in range(a))
    ready: list[tuple[int, Fraction, str, int, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, deadline, s, j = jobs[at]
            heapq.heappush(ready, (deadline, -weight[s], s, j, release))
            at += 1
        deadline, _, s, j, release = heapq.heappop(ready)
        out.append((s, j, slot, release, deadline))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """For each phase: slots per source, first block per source, periods, first slot."""
    out, done, first = [], dict.fromkeys(blocks, 0), 0
    while live := {s: weights[s] for s in blocks if done[s] < blocks[s]}:
        slots = slots_per_period(live, period)
        periods = min(-(-(blocks[s] - done[s]) // a) for s, a in slots.items())
        out.append({"slots": slots, "from": {s: done[s] for s in slots}, "periods": periods, "first": first})
        for s, a in slots.items():
            done[s] = min(blocks[s], done[s] + a * periods)
        first += periods * sum(slots.values())
    return out


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
    block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA,
) -> DataFrame:
    """Rows with ``mix_slot`` (slot of the row's block), ``mix_block`` (number of the block in its source), ``mix_place`` (place in the block),
    ``mix_phase``, ``mix_release`` and ``mix_deadline`` (slots, in the phase). Reading in the order (mix_slot, mix_place) gives the mixture.

    ``weights`` names target shares; sources it leaves out get none of the mixture and come after it, in a last phase of their own shares.
    Without it, shares follow the number of documents to the power ``alpha``.
    """
    spark = docs.sparkSession
    new = ["mix_slot", "mix_block", "mix_place", "mix_phase", "mix_release", "mix_deadline"]
    docs = docs.select(*[docs[c] for c in docs.columns if c not in new])
    names = docs.columns
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[source_col].cast("string").alias("_s"), docs[id_col].alias("_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("_h"))
    plain = plain.withColumn("_s", F.coalesce(F.concat(F.lit("="), "_s"), F.lit("null")))
    counts = {r["_s"]: r["n"] for r in plain.groupBy("_s").agg(F.count("*").alias("n")).collect()}
    share = {s: float(n) ** alpha for s, n in counts.items()}
    blocks = {s: -(-n // block) for s, n in counts.items()}
    if weights is None:
        plan = phases(blocks, share, period)
    else:
        named = {s: float(weights[s[1:]]) for s in blocks if s[1:] in weights and weights[s[1:]] > 0 and s != "null"}
        plan = phases({s: blocks[s] for s in named}, named, period)
        rest = {s: n for s, n in blocks.items() if s not in named}
        shift = plan[-1]["first"] + plan[-1]["periods"] * sum(plan[-1]["slots"].values()) if plan else 0
        plan += [p | {"first": p["first"] + shift} for p in phases(rest, share, period)]
    table, spans = [], []
    for number, phase in enumerate(plan):
        for s, j, slot, release, deadline in pfair_period(phase["slots"]):
            table.append((s, number, j, slot, release, deadline))
        length = sum(phase["slots"].values())
        for s, a in phase["slots"].items():
            spans.append((s, number, phase["from"][s], phase["from"][s] + a * phase["periods"], a, length, phase["first"]))
    jobs = spark.createDataFrame(table, "_s string, _phase long, _job long, _slot long, _release long, _deadline long")
    ranges = spark.createDataFrame(spans, "_s string, _phase long, _from long, _to long, _a long, _length long, _first long")

    # rank in the source without one task per source: rows by hash bucket, buckets by running count
    buckets = max(1, -(-sum(counts.values()) // BUCKET))
    plain = plain.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sizes = plain.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_s", "_b", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = plain.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_id")) - 1).join(before, ["_s", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_before")).withColumn("mix_block", F.floor(F.col("_rank") / block)).withColumn("mix_place", F.col("_rank") % block)
    where = (ranked["_s"] == ranges["_s"]) & (ranked["mix_block"] >= ranges["_from"]) & (ranked["mix_block"] < ranges["_to"])
    small = len(table) + len(spans) <= MAX_BROADCAST
    placed = ranked.join(F.broadcast(ranges) if small else ranges, where).drop(ranges["_s"])
    local = F.col("mix_block") - F.col("_from")
    placed = placed.withColumn("_job", local % F.col("_a")).withColumn("_turn", F.floor(local / F.col("_a")))
    placed = placed.join(F.broadcast(jobs) if small else jobs, ["_s", "_phase", "_job"])
    base = F.col("_turn") * F.col("_length")
    return placed.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], (F.col("_first") + base + F.col("_slot")).alias("mix_slot"), "mix_block", "mix_place",
        F.col("_phase").alias("mix_phase"), (base + F.col("_release")).alias("mix_release"), (base + F.col("_deadline")).alias("mix_deadline"),
    )
