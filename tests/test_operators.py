"""Operators against brute force on small skewed inputs, state transitions and gates."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery import scale
from gleanery.operators import dedup, facets, gates, quality, resolve, snapshots

NOW = datetime(2026, 9, 2, 4, 0)
PREFS = "struct<scope:string,country_code:string,province_code:string,city_code:string,district_code:string,display_name:string,raw:string>"


def skewed(n=600, seed=3):
    """Keys where one holds a third of the rows and some are NULL."""

    rnd = random.Random(seed)
    return [("hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{rnd.randrange(20)}", rnd.randrange(50), i) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(skewed(), "k string, v int, i int").repartition(7)


def grouped(data):
    out = {}
    for k, v, i in data:
        out.setdefault(k, []).append((v, i))
    return {k: sorted(x) for k, x in out.items()}


def test_rank_rows_matches_brute_force(rows):
    got = scale.rank_rows(rows, [F.col("v").asc(), F.col("i").asc()], ["k"], "r", "n").collect()
    want = {i: (place + 1, len(items)) for items in grouped(skewed()).values() for place, (_, i) in enumerate(items)}
    assert {r["i"]: (r["r"], r["n"]) for r in got} == want
    whole = scale.rank_rows(rows, [F.col("v").asc(), F.col("i").asc()], rank="r").collect()
    assert [r["i"] for r in sorted(whole, key=lambda r: r["r"])] == [i for _, _, i in sorted(skewed(), key=lambda x: (x[1], x[2]))]


def test_lag_and_streak_match_brute_force(rows):
    lagged = {r["i"]: r["p"] for r in scale.lag_rows(rows, [F.col("v").asc(), F.col("i").asc()], ["k"], "i", "p").collect()}
    streak = {r["i"]: r["s"] for r in scale.streak_rows(rows, [F.col("v").asc(), F.col("i").asc()], ["k"], F.col("i") % 5 == 0, "s").collect()}
    for items in grouped(skewed()).values():
        before, run = None, 0
        for _, i in items:
            run = 0 if i % 5 == 0 else run + 1
            assert lagged[i] == before and streak[i] == run
            before = i


def test_lookup_join_is_the_same_with_and_without_broadcast(spark, rows):
    lookup = spark.createDataFrame([(f"k{i}", i) for i in range(20)] + [("hot", 99)], "k string, x int")
    small = scale.lookup_join(rows, lookup, "k")
    shuffled = scale.lookup_join(rows, lookup, "k", max_rows=3)
    key = lambda df: sorted((r["i"], r["x"] if r["x"] is not None else -1) for r in df.collect())
    assert key(small) == key(shuffled) and small.count() == 600


def test_first_row_per_key_is_limited_before_the_shuffle(rows):
    plan = dedup.first_per_key(rows, ["k"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial before the exchange, final after it


def test_spread_sample_and_chunks(rows):
    picked = {}
    for r in dedup.spread_sample(rows, ["k"], [F.col("i").asc()]).collect():
        picked.setdefault(r["k"], set()).add(r["i"])
    for k, items in grouped([(k, i, i) for k, _, i in skewed()]).items():
        n = len(items)
        want = {items[j][1] for j in (range(n) if n <= 3 else (0, n // 2, n - 1))}
        assert picked[k] == want
    chunks = scale.collect_in_chunks(rows.filter("k is not null"), ["k"], "i", [F.col("i")], 50, "items").filter("k = 'hot'").orderBy("chunk_no").collect()
    assert [i for c in chunks for i in c["items"]] == list(range(0, 600, 3)) and max(len(c["items"]) for c in chunks) == 50


@pytest.mark.parametrize(("history", "previous", "baseline"), [([1, 10, 11, 12], None, 11), ([10, 11], None, 10), ([], None, None), ([5], 8, 6), ([8], 8, 8), ([], 3, 3)])
def test_drop_baseline(spark, history, previous, baseline):
    df = spark.createDataFrame([(history, previous)], "h array<bigint>, p bigint")
    got = df.select(quality.drop_baseline(F.col("h"), F.col("p") if previous is not None else None).alias("x")).first()["x"]
    assert got == baseline


def test_source_quality_cases(spark):
    counts = spark.createDataFrame([("a", 1, 1, 1, 0, 0), ("b", 1, 1, 1, 0, 0)], "source_id string, item_count bigint, unique_count bigint, accepted bigint, rejected bigint, unknown_items bigint")
    log = spark.createDataFrame([("a", True, 0, 3, None, NOW), ("b", False, 0, 10, None, NOW)], "source_id string, fetch_ok boolean, raw_count bigint, previous_count bigint, count_history array<bigint>, fetched_at timestamp")
    got = {r["source_id"]: r for r in quality.source_quality(counts, log, "source_id", F.lit(NOW)).collect()}
    assert got["a"]["quarantined"] and "50_percent" in got["a"]["reason"] and got["a"]["baseline_source"] == "previous_run"
    assert not got["b"]["quarantined"] and got["b"]["reason"] == "fetch_failed_preserve_previous_catalog"


JOB = "source_id string, id string, content_hash string, status string, first_missing_successes int, first_seen_at timestamp, last_verified_at timestamp, changed_at timestamp"


def advance(spark, old, new, complete=True, quarantined=False):
    frame = lambda x: spark.createDataFrame([tuple(r) for r in x], JOB)
    flags = spark.createDataFrame([("s", complete, quarantined)], "source_id string, complete boolean, quarantined boolean")
    return snapshots.advance_lifecycle(frame(old), frame(new), flags, F.lit(NOW)).collect()


def test_lifecycle_transitions(spark):
    seen = datetime(2026, 1, 1)
    job = ("s", "1", "h", "ACTIVE", 0, seen, seen, None)
    once = advance(spark, [job], [])
    assert (once[0]["status"], once[0]["first_missing_successes"]) == ("ACTIVE", 1)
    twice = advance(spark, once, [])
    assert (twice[0]["status"], twice[0]["first_missing_successes"]) == ("CLOSED", 2)
    assert advance(spark, once, [], complete=False)[0]["first_missing_successes"] == 1
    assert advance(spark, once, [], quarantined=True)[0]["status"] == "ACTIVE"
    back = advance(spark, twice, [("s", "1", "h2", "ACTIVE", 0, NOW, NOW, None)])[0]
    assert (back["status"], back["first_missing_successes"], back["first_seen_at"], back["changed_at"]) == ("ACTIVE", 0, seen, NOW)
    same = advance(spark, [job], [job])[0]
    assert tuple(same) == job
    assert advance(spark, [], [job], complete=False)[0]["id"] == "1"


def test_longest_alias(spark):
    texts = spark.createDataFrame([(1, "2027 腾讯音乐 校招"), (2, "腾讯 秋招"), (3, "nothing"), (4, "x Ten Cent")], "n int, t string")
    aliases = spark.createDataFrame([("t", "腾讯", 0), ("m", "腾讯音乐", 1), ("t", "tencent", 2), ("z", "腾讯", 3)], "company_id string, alias string, seq int")
    got = resolve.longest_alias(texts, "n", "t", aliases)
    assert {r["n"]: r["matched_company_id"] for r in got.collect()} == {1: "m", 2: "t", 3: None, 4: "t"}
    assert resolve.longest_alias(texts, "n", "t", aliases.limit(0)).filter("matched_company_id is not null").count() == 0


def test_longest_alias_in_long_texts_equals_search(spark):
    r = random.Random(6)
    names = ["".join(r.choice("abé𝒳腾 ") for _ in range(r.choice([2, 3, 4, 7, 8, 9, 15, 16, 40]))) for _ in range(60)] + ["z" * 2000 + "q", "zz", None, ""]
    bodies = ["".join(r.choice("abé𝒳腾z ") for _ in range(r.choice([0, 1, 5, 300]))) + r.choice(names[:60]) for _ in range(60)] + ["z " * 2500 + "Q" + "ab" * 60_000, None, "z" * 9000]
    aliases = spark.createDataFrame([(f"c{i}", a, i) for i, a in enumerate(names)], "company_id string, alias string, seq int")
    texts = spark.createDataFrame(list(enumerate(bodies)), "n int, t string")
    key = lambda s: re.sub(r"[\s·・()（）【】\[\]{}]+", "", (s or "").strip().lower())
    want = {}
    for n, body in enumerate(bodies):
        hits = sorted((-len(key(a)), i) for i, a in enumerate(names) if len(key(a)) >= 2 and key(a) in key(body))
        want[n] = f"c{hits[0][1]}" if hits else None
    assert {x["n"]: x["matched_company_id"] for x in resolve.longest_alias(texts, "n", "t", aliases).collect()} == want


def test_identity_match(spark):
    companies = spark.createDataFrame([("one", "甲公司", ["甲"], ["000001"], None), ("two", "乙公司", [], [], "https://b.example.com")], "company_id string, name string, aliases array<string>, stock_codes array<string>, homepage string")
    cands = spark.createDataFrame([("c1", "1", "x", "y", None), ("c2", "000001", "乙公司", "", None), ("c3", None, "x", "甲", None), ("c4", None, "x", "y", "www.b.example.com"), ("c5", None, "x", "y", None)],
                                  "candidate_id string, stock_code string, legal_name string, short_name string, homepage string")
    got = {r["candidate_id"]: (r["matched_company_id"], r["match_method"]) for r in resolve.match_identity(cands, companies).collect()}
    assert got == {"c1": ("one", "STOCK_CODE"), "c2": (None, "CONFLICT"), "c3": ("one", "LEGAL_NAME_OR_ALIAS"), "c4": (None, None) if got["c4"][0] is None else ("two", "OFFICIAL_DOMAIN"), "c5": (None, None)}
    assert got["c4"] == ("two", "OFFICIAL_DOMAIN")


def test_location_conditions_hold_on_one_place(spark):
    places = [("MAINLAND_CHINA", "CN", "BJ", "BJ-北京", None, "北京", "北京"), ("MAINLAND_CHINA", "CN", "SH", "SH-上海", None, "上海", "上海")]
    wide = [("MAINLAND_CHINA", "CN", None, None, None, "全国", "全国")]
    df = spark.createDataFrame([(1, places), (2, wide)], f"n int, locations array<{PREFS}>")
    fits = lambda **k: {r["n"] for r in df.filter(facets.matches_location("locations", **k)).collect()}
    assert fits(provinces=["BJ"], city_codes=["SH-上海"]) == {2}
    assert fits(provinces=["SH"], city_codes=["SH-上海"]) == {1, 2}
    assert fits() == {1, 2}


EVIDENCE = {"official_reverse_link": True, "public_access_no_auth": True, "robots_terms_allowed": True, "current_cohort_evidence": True, "campus_evidence": True, "company_identity_exact": True, "apply_domain_verified": True,
            "sampled_jobs": 3, "required_field_completeness": 1.0, "invalid_row_ratio": 0.0, "duplicate_ratio": 0.0, "consecutive_healthy_runs": 2, "anomalous_drop": False}


@pytest.mark.parametrize(("adapter", "change", "conclusion"), [("greenhouse", {}, "AUTO_VERIFIED"), ("greenhouse", {"sampled_jobs": 2}, "PROVISIONAL"), ("boss", {}, "BLOCKED"), ("greenhouse", {"anomalous_drop": True}, "PROVISIONAL")])
def test_evidence_gate(spark, adapter, change, conclusion):
    ev = {**EVIDENCE, **change}
    row = spark.range(1).select(F.lit(adapter).alias("adapter"), F.lit("https://a.example.com").alias("source_url"), F.lit(None).cast("string").alias("endpoint"), F.struct(*[F.lit(v).alias(k) for k, v in ev.items()]).alias("evidence"))
    got = row.select(gates.evidence_reasons().alias("r")).select("r", gates.evidence_conclusion("r").alias("c")).first()
    assert got["c"] == conclusion and (got["r"] == []) == (conclusion == "AUTO_VERIFIED")


def test_gates_raise_before_writing(spark):
    sources = spark.createDataFrame([("VERIFIED", "stale"), ("TARGET", "healthy")], "status string, health string")
    with pytest.raises(gates.GateFailed, match="verified_source_gate_failed:0<1"):
        gates.require_verified_sources(sources, 1)
    jobs = spark.createDataFrame([("a", "ACTIVE", "https://x", "http://x")], "title string, status string, apply_url string, source_url string")
    assert gates.catalog_check(jobs, ["title"]).first()["non_https_links"] == 1


def test_authority_list_check(spark):
    rows = spark.createDataFrame([(1, "a", "p", "s"), (2, "b", "p", "s")], "rank int, name string, province string, segment string")
    check = lambda n: gates.dense_rank_check(rows, "rank", n, F.lower("name"), ["province"]).first()
    assert check(2)["valid"] and not check(3)["valid"] and "row_count_2_expected_3" in check(3)["reasons"]


def test_duplicate_removal_is_idempotent(rows):
    once = dedup.latest_per_key(rows, ["k"], "v", ["i"])
    again = dedup.latest_per_key(once, ["k"], "v", ["i"])
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
