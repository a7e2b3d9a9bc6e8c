"""Sharding, divergence audit and importance resampling against brute force, on null, empty, long, tied, repeated and clashing rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import divergence, resampling, runs, sharding

SCHEMA = "doc_id long, text string, lang string, source string, shard string, rank string, weight string, c0 string, _row string, id string"


def words(r, n, kinds=300):
    return " ".join(f"w{'abcdefghij'[k % 10] * (k % 7)}{'xyzuv'[k % 5]}{'kl'[k % 2]}" for k in (int(kinds * r.random() ** 2) for _ in range(n)))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "s", "r", "w", "c", "_", "i") for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, words(r, r.choice([0, 3, 19, 20, 60])) + r.choice(["", " Éa-B9", " x", "\tÀ1é"]), r.choice(["en", "de", None]), r.choice(["a", "b", "ü", None])) for i in range(150)]
    out += [(150, None, "en", "a"), (151, "", "fr", "a"), (151, "", "fr", "a"), (152, "12 -- 34", "fr", "b"), (None, "no id here", "en", "a"), (None, None, None, None)]
    out += [(160 + i, "ab" * 3000 + " " + words(r, 30), "en", "c") for i in range(3)] + [(170, words(r, 20000), "en", "a")]
    return out + out[20:25]


@pytest.mark.parametrize("keep,pattern", [(runs.LETTERS, rb"[A-Za-z\x80-\xff]+"), (runs.WORD_CHARS, rb"[A-Za-z0-9\x80-\xff]+")])
def test_runs_equal_the_pattern(keep, pattern):
    r = random.Random(1)
    for size in (1, 40, 1 << 20):
        texts = ["".join(r.choice("aZ9é -") for _ in range(r.randint(0, 30))) for _ in range(200)]
        got = []
        for part in runs.word_runs(pa.array(texts, pa.string()), keep, size):
            flat, at = part.words.to_pylist(), 0
            for n in part.per_row.tolist():
                got.append(flat[at: at + n])
                at += n
        assert got == [[w.lower() for w in re.findall(pattern, t.encode())] for t in texts]


def test_every_row_has_one_slot_and_keys_one_shard(spark, rows):
    docs = docs_of(spark, rows)
    got = sharding.assign_shards(docs).collect()
    assert sorted(map(str, ((x.doc_id, x.text, x.c0, x._row) for x in got))) == sorted(map(str, ((i, t, "c", "_") for i, t, _, _ in rows)))
    slots, of = collections.defaultdict(list), {}
    for x in got:
        data = (x.text or "").encode()
        assert (x.size, x.text_crc32, x.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert of.setdefault(x.doc_id, (x.shard, x.grown_shard)) == (x.shard, x.grown_shard)
        assert x.grown_shard in (x.shard, 8)
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    again = sharding.digest(sharding.assign_shards(docs.repartition(7), carry=["doc_id"])).collect()
    assert sorted(map(str, again)) == sorted(str(type(again[0])(**{c: x[c] for c in again[0].asDict()})) for x in got)  # slots don't depend on partitions
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_shares_follow_the_weights_and_few_keys_move(spark):
    keys = spark.range(40_000).selectExpr("id as doc_id", "'' as text")
    got = sharding.assign_shards(keys, (1.0, 2.0, 5.0), (1.0, 2.0, 5.0, 2.0))
    share = {r.shard: r["count"] / 40_000 for r in got.groupBy("shard").count().collect()}
    assert all(abs(share[s] - w / 8) < 0.01 for s, w in enumerate((1, 2, 5)))
    moved = got.filter("shard != grown_shard").groupBy("grown_shard").count().collect()
    assert len(moved) == 1 and moved[0].grown_shard == 3 and abs(moved[0]["count"] / 40_000 - 0.2) < 0.01
    fewer = sharding.assign_shards(keys, (1.0, 2.0, 5.0), (1.0, 2.0))
    assert fewer.filter("shard != grown_shard and shard != 2").count() == 0
    text_keys = sharding.assign_shards(keys.selectExpr("cast(doc_id as string) as doc_id", "text"), (1.0, 2.0, 5.0))
    assert text_keys.selectExpr("cast(doc_id as long) as doc_id", "shard").exceptAll(got.select("doc_id", "shard")).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(keys, (1.0, 0.0))


def test_shard_files_hold_the_rows_in_slots(spark, rows, tmp_path):
    placed = sharding.assign_shards(docs_of(spark, rows), (1.0, 3.0))
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text", "shard", "slot").collect())) == sorted(map(str, placed.select("doc_id", "text", "shard", "slot").collect()))


def plain_audit(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in row[1:4]) for row in rows]
    cut = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, lang, source in rows]
    out = []
    for lang in {c[0] for c in cut}:
        docs, whole, own = collections.Counter(), collections.Counter(), {}
        for la, source, terms in cut:
            if la == lang:
                docs.update(set(terms))
                whole.update(terms)
                own.setdefault(source, collections.Counter()).update(terms)
        kept = [t for t in docs if docs[t] >= min_docs]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s)
            tells = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -x, k) for part, found in (("pair", pairs), ("term", tells)) for k, (x, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("first_level", [1, 6, 64])
def test_audit_equals_brute_force(spark, rows, first_level):
    got = divergence.audit_divergence(docs_of(spark, rows), first_level=first_level, top_terms=40)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, top=40)


def test_audit_with_clashing_bits_empty_tables_and_large_counts(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BITS", 64)  # nearly every bit is set: nothing is ruled out early
    some = rows[:60] + [(900 + i, "solo" if i < 3 else None, "xx", f"s{i}") for i in range(5)]
    assert sorted(map(tuple, divergence.audit_divergence(docs_of(spark, some)).collect())) == plain_audit(some)
    assert divergence.audit_divergence(docs_of(spark, rows).limit(0)).count() == 0
    from pyspark.sql import functions as F

    big = spark.range(1).select(divergence.share(F.lit(10**17), F.lit(3 * 10**17), F.lit(10**6)).alias("p")).first().p
    assert big == 1 + 10**9 * (10**17 + 1) // (3 * 10**17 + 10**6)


def test_audit_equals_its_sql(spark, root):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{root}/documents.parquet'")
    want = sorted(con.execute(divergence.SQL).fetchall())
    got = sorted(map(tuple, divergence.audit_divergence(spark.read.parquet(f"{root}/documents.parquet")).collect()))
    assert got == want and len(got) > 1000


def plain_draw(rows, target, percent=25):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [" ".join(p) for p in zip(w, w[1:])]]

    cut = [feats(row[1]) for row in rows]
    s, t = collections.Counter(b for _, f in cut for b in f), collections.Counter(b for x in target for b in feats(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for (i, *_), (n, f) in zip(rows, cut):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return out, drawn


@pytest.mark.parametrize("finish,percent", [(1, 25), (8192, 25), (1, 99), (1, 100), (1, 0)])
def test_resampling_equals_brute_force(spark, rows, finish, percent):
    r = random.Random(8)
    target = [words(r, 40, 20) for _ in range(10)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    weighed = resampling.weigh(docs_of(spark, rows), bench)
    got = resampling.draw(weighed, percent, finish=finish).collect()
    every, drawn = plain_draw(rows, target, percent)
    assert sorted(map(str, ([x.doc_id, x.n_features, x.weight, x.score, x.n_words] for x in got))) == sorted(map(str, every))
    ranked = sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])
    assert [x["rank"] for x in ranked] == list(range(1, len(drawn) + 1))
    assert [(x.doc_id, x.score) for x in ranked] == [(x[0], x[3]) for x in drawn]
    assert {x.c0 for x in got} == {"c"} and {x.id for x in got} == {"i"}


def test_resampling_of_empty_tables_ties_and_text_ids(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "a b " * 15, "e")] * 90 + [(9, "c " * 30, "e")] * 10, "doc_id long, text string, extra string").repartition(5)
    drawn = resampling.draw(resampling.weigh(docs, bench), finish=1).filter("rank is not null").collect()
    assert sorted(x["rank"] for x in drawn) == list(range(1, 26))
    assert resampling.draw(resampling.weigh(docs.limit(0), bench)).count() == 0
    assert resampling.draw(resampling.weigh(docs, bench.limit(0))).filter("rank is not null").count() == 25
    named = docs.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert resampling.draw(resampling.weigh(named, bench), finish=1).filter("rank is not null").count() == 25


def test_pair_checksums_with_long_words():
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcé") for _ in range(r.choice([1, 5, 63, 64, 65, 300]))) for _ in range(400))
    w = text.encode().split()
    (part,) = runs.word_runs(pa.array([text]), runs.WORD_CHARS)
    got_rows, crc = resampling.features(part)
    assert crc.tolist() == [zlib.crc32(x) for x in w] + [zlib.crc32(b" ".join(p)) for p in zip(w, w[1:])] and not got_rows.any()


def test_weighted_median_rules_out_a_quarter():
    r = np.random.default_rng(4)
    for _ in range(50):
        parts = [np.sort(r.integers(0, 1000, r.integers(1, 60)))[::-1] for _ in range(r.integers(1, 12))]
        pivot = resampling.weighted_median([(len(p), (int(p[len(p) // 2]), 0, 0)) for p in parts])[0]
        every = np.concatenate(parts)
        assert min((every >= pivot).sum(), (every <= pivot).sum()) * 4 >= len(every)


def test_later_levels_read_only_longer_terms():
    texts = ["abcdefghijklm ab éééééééé x", "", "abcdefghijkl", "Abcdefghijklm abcdefghijklm zz nopqrstuvwxyzz"]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 4), pa.array(["s"] * 4), pa.array(texts)], ["lang", "source", "text"])
    parts = list(divergence.slices(batch, 12))
    assert [sorted(p.dictionary.to_pylist()) for p in parts] == [[b"abcdefghijklm", b"nopqrstuvwxyzz", "éééééééé".encode()]]
    assert sorted(zip(parts[0].rows.tolist(), parts[0].counts.tolist())) == [(0, 1), (0, 1), (3, 1), (3, 2)]
    whole = next(runs.word_runs(pa.array(texts), runs.LETTERS))
    assert whole.per_row.tolist() == [4, 0, 1, 4] and divergence.FIRST_LEVEL == 12
