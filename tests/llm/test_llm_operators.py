"""Each operator against a brute-force version, on null, empty, long, repeated and tied rows, and on empty tables."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import decontam, lm, mixing, quality, simhash, suffix, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, score string, n_tokens string, mix_slot string, n_words string"  # clashing names


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "s", None, "m", "w") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def words(r, n, kinds=400):
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


def test_fuzzy_keys_meet_within_four_bits():
    golay, r = simhash.Golay(), random.Random(1)
    assert set(golay.valid.sum(axis=1).tolist()) == {1, 6}
    for _ in range(400):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 4)):
            y ^= 1 << b
        a, b = (set(simhash.fuzzy_keys(np.array([v], np.uint64), golay)[0].tolist()) for v in (x, y))
        assert a & b


def test_simhash_classes(spark):
    r = random.Random(2)
    base = [words(r, 300) for _ in range(12)]
    texts = [None, "", " \t ", "one two", "ONE  two"] + base + [b.replace("w7 ", "w8 ", 1) for b in base] + base[:3] + [words(r, 30) for _ in range(10)] + ["x " * 20000]
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]

    def plain(t):
        w = (t or "").lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i: i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    assert fps == [plain(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[i] = label[j] = min(label[i], label[j])
    for block in (4096, 2):  # large keys are dealt in blocks, with the same classes
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_duplicates(docs_of(spark, texts), block=block)).collect()}
        assert got == {i: (f"{fps[i]:016x}", label[i]) for i in range(len(texts))}
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_decontamination(spark):
    r = random.Random(3)
    items = [(i, words(r, r.choice([3, 10, 14, 40]), 30)) for i in range(8)] + [(8, None), (9, "... !"), (10, "Éa b9"), (0, "again this one has other words in it than before ok")]
    texts = [None, "", "nothing here"] + [words(r, 30, 30) + ", " + items[k % 8][1].upper() + ". " + words(r, 20, 30) for k in range(20)] + ["x éA-B9 y", "ÉA b9"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (20_000, 5):  # one automaton, or several
        rows = decontam.digest(decontam.find_contamination(docs_of(spark, texts), bench, max_patterns=limit)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows} == {i: decontam.brute_force(t, items) for i, t in enumerate(texts)}
    spans = {r.doc_id: r.hit_spans for r in decontam.find_contamination(docs_of(spark, ["é zz Éa  b9!", None]), bench.filter("item_id = 10"), n=2).collect()}
    assert spans == {0: [5, 11], 1: []}  # code points of the original
    spans = decontam.find_contamination(docs_of(spark, ["é zz, Éa  B9!"]), bench.filter("item_id = 10")).first().hit_spans
    assert spans == [6, 12]
    assert decontam.find_contamination(docs_of(spark, ["a"]), bench.limit(0)).first().n_hit == 0


def test_repeats(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(900)) for _ in range(4)]
    texts = [None, "", "a" * 700, "é" * 400, base[0], base[0], base[1][:500] + "X" + base[1][501:]]
    for _ in range(25):
        b, a = r.choice(base), r.randint(0, 500)
        texts.append("".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 90))) + b[a: a + r.randint(50, 400)])
    want = {i: x for i, x in enumerate(suffix.brute_force(texts, 100))}
    for limit in (suffix.MAX_BYTES, 0):  # suffix arrays, or place by place
        rows = suffix.digest(suffix.remove_repeats(docs_of(spark, texts), length=100, max_bytes=limit)).collect()
        assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows} == want
    line = "".join(r.choice("abcdefgh ") for _ in range(80))  # one line that every text holds, in different surroundings
    texts = [f"{words(r, 30)} {line}{words(r, 5)}{line} {words(r, 30)}" for _ in range(60)] + [f"x{line}{line}y{base[2][:300]}{line}", base[2][:200]]
    want = {i: x for i, x in enumerate(suffix.brute_force(texts, 150))}
    rows = suffix.digest(suffix.remove_repeats(docs_of(spark, texts).withColumn("ids", F.lit(1)).withColumn("K1", F.lit("x")), length=150)).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows} == want
    named = spark.createDataFrame([("a", base[0]), (None, base[0]), ("a", "q"), ("b", None)], "doc_id string, text string")
    rows = suffix.remove_repeats(named, length=100).collect()  # text, null and repeated ids: one row each
    assert sorted((x.doc_id or "", x.n_bytes, x.n_removed) for x in rows) == [("", 900, 900), ("a", 1, 0), ("a", 900, 900), ("b", 0, 0)]
    groups = suffix.repeats(docs_of(spark, [base[0] + "p", "q" + base[0][:300], "rr" + base[0][:300] + "z"]), length=100, groups=True).filter("group is not null").collect()
    assert max(collections.Counter(g.group for g in groups).values()) == 3
    assert suffix.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_block_max_search_is_exact():
    r = np.random.default_rng(1)
    vectors = []
    for _ in range(300):
        t = np.sort(r.choice(40, r.integers(1, 8), replace=False))
        vectors.append(toxicity._vector(t, r.integers(1, 3, len(t)), np.ones(40)))
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 40, block=8)
    for q in range(300):
        s = np.round(dense @ dense[q], 9)
        s[q] = -1
        want = np.lexsort((np.arange(300), -s))[:15]
        rows, near = index.top(*vectors[q], 15, skip=q)
        assert rows.tolist() == want[s[want] > 0].tolist() and np.allclose(near, s[rows])


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(7)
    texts = [words(r, 60) + (f" {r.choice(['vilew', 'nastyx', 'crudelt'])}{r.choice('abc')} " if i % 5 == 0 else " ") + words(r, 20) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(450)] + [(0, 1), (None, 1)], "doc_id long, toxic int")
    docs = docs_of(spark, texts + [None, ""])
    rows = {x.doc_id: x for x in toxicity.digest(toxicity.score_toxicity(docs, labels)).collect()}
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    wrong = sum(rows[i].predicted != int(i % 5 == 0) for i in range(500))
    assert wrong <= 5 and rows[500].score == rows[501].score < 0.3 and rows[0].neighbours
    bare = toxicity.score_toxicity(docs, labels.limit(0))
    assert {x.score for x in bare.select("score").collect()} == {0.0}


def test_toxicity_with_many_toxic_labels_few_labels_and_unmarked_copies(spark):
    r = random.Random(8)
    marked = [words(r, 60) + (f" {r.choice(['vilew', 'nastyx', 'crudelt'])} " if i % 5 < 2 else " ") + words(r, 20) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 5 < 2)) for i in range(450)], "doc_id long, toxic int")
    rows = {x.doc_id: x.predicted for x in toxicity.digest(toxicity.score_toxicity(docs_of(spark, marked), labels)).collect()}
    assert sum(rows[i] != int(i % 5 < 2) for i in rows) <= 10  # 40 % toxic

    taught = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    plain = [" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(80)) for _ in range(100)]
    toxic = taught[::10]  # 10 % or less, no term in common
    copies = {100 + j: i for j, i in enumerate(toxic)}
    few = spark.createDataFrame([(i, int(i in toxic)) for i in range(100)], "doc_id long, toxic int")
    rows = {x.doc_id: x for x in toxicity.digest(toxicity.score_toxicity(docs_of(spark, plain + [plain[i] for i in copies.values()]), few)).collect()}
    assert all(rows[c].neighbours[0] == i and rows[c].cosines[0] == 1.0 for c, i in copies.items())
    assert all(rows[c].predicted == 1 for c in copies) and not any(rows[i].predicted for i in range(100) if i not in toxic)


@pytest.mark.parametrize("dense", [1, 4, 16, 10_000])
def test_block_max_search_of_long_queries_is_exact(monkeypatch, dense):
    """From all terms rare to all common, with ties: whole rows repeat."""
    monkeypatch.setattr(toxicity, "DENSE", dense)
    r = np.random.default_rng(2)
    chance = 1 / np.arange(1, 201) / (1 / np.arange(1, 201)).sum()
    idf = np.log(np.arange(2, 202))
    vectors = []
    for i in range(240):
        t = np.sort(r.choice(200, r.integers(1, 60), replace=False, p=chance))
        vectors.append(vectors[i - 3] if i % 7 == 6 else toxicity._vector(t, r.integers(1, 5, len(t)), idf))
    full = np.zeros((240, 200))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 200, block=8)
    for q in range(240):
        s = np.round(full @ full[q], 9)
        s[q] = -1
        want = np.lexsort((np.arange(240), -s))[:15]
        rows, near = index.top(*vectors[q], 15, skip=q)
        assert rows.tolist() == want[s[want] > 0].tolist() and np.allclose(near, s[rows])


def test_toxicity_terms_equal_plain_counts():
    r = random.Random(4)
    pieces = ["Straße", "naïve", "abc", "ABCDE", "abcdefg", "x1y", "½", "²a", "日本語、です", "_a_", "e\u0301a", "I\u0307", "\u2028", "\x85", "\u3000", "!", " ", "\n", "7", "-"]
    terms = ["abc", "abcd*", "abcde", "abcdefg", "abcde*", "naïve", "a", "stra*", "日本語", "です"]
    counter = toxicity.TermCounter(terms)
    for _ in range(400):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 30)))
        plain = re.findall(r"[^\W\d_]+", text.lower())
        assert toxicity.words_of(text) == plain
        want = collections.Counter(terms.index(t) for w in plain for t in toxicity.terms_of(w) if t in terms)
        got, tf, any_word = counter.count(text)
        assert dict(zip(got.tolist(), tf.tolist())) == want and got.tolist() == sorted(want) and any_word == bool(plain)


def test_toxicity_fit_keeps_texts_off_the_driver(spark, monkeypatch):
    r = random.Random(10)
    texts = [words(r, 30) + (" vilew" if i % 4 == 0 else "") for i in range(100)] + ["12 34", None]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(102)], "doc_id long, toxic int")
    fetched = []
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(type(docs), name, lambda self, f=getattr(type(docs), name): fetched.append(self.columns) or f(self))
    model = toxicity.learn(docs, labels)
    assert fetched and not any("text" in c for c in fetched)
    taught = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    counter = toxicity.TermCounter(model["terms"].to_pylist())
    assert model["ids"] == taught and model["labels"].tolist() == [float(i % 4 == 0) for i in taught]
    for i, (terms, tf) in zip(taught, toxicity._vectors(model)):
        want = counter.count(texts[i])
        assert terms.tolist() == want[0].tolist() and tf.tolist() == want[1].tolist()


def test_toxicity_text_ids_and_clashing_columns(spark):
    r = random.Random(9)
    rows = [(f"d{i}", words(r, 40) + (" vilew" if i % 4 == 0 else ""), "mine", i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, score string, cosines int")
    labels = spark.createDataFrame([(f"d{i}", int(i % 4 == 0)) for i in range(100)], "doc_id string, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    assert got.columns == ["doc_id", "text", "score", "neighbours", "cosines"] and got.schema["neighbours"].dataType.elementType.simpleString() == "string"
    found = got.collect()
    assert len(found) == 120 and all(set(x.neighbours) <= {f"d{i}" for i in range(100)} and x.neighbours for x in found)
    assert sum((x.score >= 0.3) != (int(x.doc_id[1:]) % 4 == 0) for x in found) <= 3
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0 and toxicity.score_toxicity(docs, labels.limit(0)).first().neighbours == []


def test_pfair_schedule():
    r = random.Random(3)
    for _ in range(20):
        slots = mixing.slots_per_period({f"s{i}": r.random() ** 3 + 0.001 for i in range(r.randint(1, 25))}, r.choice([30, 100]))
        period, done = sum(slots.values()), dict.fromkeys(slots, 0)
        for s, j, slot, release, deadline in mixing.pfair_period(slots):
            assert release <= slot < deadline and done[s] == j
            done[s] += 1
            assert all(abs(done[q] - (slot + 1) * a / period) < 1 for q, a in slots.items())


def test_mixing_places_every_row_once(spark):
    rows = [(i, "t", ["big", "mid", None][0 if i % 3 else i % 2 + 1]) for i in range(600)] + [(7, "t", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block=8, period=20).collect()
    assert sorted((x.doc_id, x.source or "") for x in got) == sorted((a, c or "") for a, _, c in rows)
    assert len({(x.mix_slot, x.mix_place) for x in got}) == len(rows)
    assert all(len({x.source for x in g}) == 1 for _, g in itertools.groupby(sorted(got, key=lambda x: x.mix_slot), key=lambda x: x.mix_slot))
    order = sorted({(x.mix_slot, x.source or "", x.mix_block) for x in got if x.mix_phase == 0})
    share = {s: n**0.5 for s, n in collections.Counter(c or "" for _, _, c in rows).items()}
    slots = mixing.slots_per_period(share, 20)
    done = collections.Counter()
    for place, (_, s, block) in enumerate(order[: len(order) // 20 * 20], 1):
        assert block == done[s]
        done[s] += 1
        assert all(abs(done[q] - place * a / 20) < 1 for q, a in slots.items())
    named = mixing.mix_sources(docs, {"mid": 1.0, "big": 3.0}, block=8, period=20).collect()
    assert min(x.mix_slot for x in named if x.source is None) > max(x.mix_slot for x in named if x.source)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 3_000_000, "<p>é</p>", "\r\n\r\nWARC/1.1\r\n"]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", h, 1) for i, h in enumerate(html)] + [(5, "u", "<p>é</p>", 1), (None, "u", "<p>é</p>", 1)], "page_id long, url string, html string, payload_bytes int")
    got = sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.digest(warc.round_trip(pages)).collect()), key=str)

    def row(i, h, last):
        data = (h or "").encode()
        return i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == last else "revisit", None if i == last else last

    want = [row(0, None, 1), row(1, "", 1), row(2, html[2], 5), row(3, html[2], 5), row(4, html[4], 4), row(5, html[2], 5), row(5, html[2], 5), row(6, html[6], 6), row(None, html[2], 5)]
    assert got == sorted(want, key=str)
    held = {x.page_id: x.html for x in warc.round_trip(pages, payloads=True).filter("record_type = 'response'").collect()}
    assert held[4] == html[4] and held[6] == html[6]
    assert all(x[3] == "response" for x in [tuple(r) for r in warc.digest(warc.round_trip(pages.filter("page_id < 4"), min_revisit=1_000)).collect()])
    assert warc.round_trip(pages.limit(0)).count() == 0


def plain_kneser_ney(train, texts):
    def tok(t):
        return [*(t or "").encode().lower().split(), b" end"]

    count, pairs = collections.Counter(), collections.Counter()
    for t in train:
        count.update(tok(t))
        pairs.update(zip([b" begin", *tok(t)], tok(t)))
    cont = collections.Counter(w for _, w in pairs)
    of = [[sum(x == k for x in c.values()) for k in (1, 2, 3, 4)] for c in (pairs, cont)]
    d2, d1 = (lm.discounts(*x) for x in of)
    total, gap, types, n, v = collections.Counter(), collections.Counter(), len(pairs), sum(count.values()), len(count)
    for (a, _), c in pairs.items():
        total[a] += c
        gap[a] += d2[min(c, 3)]
    rest = sum(d1[min(c, 3)] for c in cont.values()) / types

    def p(a, w):
        low = max(cont[w] - d1[min(cont[w], 3)], 0) / types + rest / (v + 1)
        return max(pairs[a, w] - d2[min(pairs[a, w], 3)], 0) / total[a] + gap[a] / total[a] * low if total[a] else low

    for t in texts:
        w = tok(t)
        yield len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(a, x)) for a, x in zip([b" begin", *w], w))


@pytest.mark.parametrize("shard_bytes", [lm.SHARD_BYTES, 500])
def test_kneser_ney(spark, shard_bytes):
    r = random.Random(9)
    texts = [None, "", "The the THE"] + [words(r, r.randint(1, 80), 60) + " rare" * (i % 2) for i in range(80)] + ["unseen words é"]
    docs = docs_of(spark, texts)
    folder = lm.train(docs.filter("doc_id < 60"), shard_bytes=shard_bytes)
    got = {x.doc_id: x for x in lm.score_texts(docs, folder).collect()}
    for i, (n, known, total, base, score) in enumerate(plain_kneser_ney(texts[:60], texts)):
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total)
        assert math.isclose(x.base_score, base, rel_tol=1e-12) and math.isclose(x.score, score, rel_tol=1e-9)
    none = lm.score_texts(docs, lm.train(docs.limit(0))).filter("doc_id = 2").first()
    assert (none.n_known, none.train_tokens, none.score) == (0, 0, 0.0)


def test_quality(spark):
    r = random.Random(11)
    good = "\n".join(words(r, 30, 3000) + "." for _ in range(6))
    junk = "\n".join(" ".join(f"w{r.randrange(3000)}%%% ##" for _ in range(20)) for _ in range(6))
    texts = [None, "", "\n\n", good, junk, good + "\n" + "BUY!! " * 3, "same line of words here\n" * 30, "a b c d e f g " * 9] + [good] * 2
    many = [("\n".join(words(r, 25, 5000) + "." for _ in range(4)), 1) for _ in range(60)] + [("\n".join(" ".join(f"x{r.randrange(999)}&&&" for _ in range(25)) for _ in range(4)), 0) for _ in range(60)]
    docs = docs_of(spark, texts + [t for t, _ in many])
    labels = spark.createDataFrame([(len(texts) + i, q) for i, (_, q) in enumerate(many)], "doc_id long, quality int")
    rows = {x.doc_id: x for x in quality.digest(quality.judge(docs, quality.learn(docs, labels))).collect()}
    for i, t in enumerate(texts):
        w = (t or "").replace(" ", "~").split()
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == (
            len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert rows[i].base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert rows[3].kept and not rows[4].kept and rows[5].kept and not rows[6].kept and not rows[0].kept
    assert quality.judge(docs, quality.learn(docs, labels.limit(0))).filter("content_share < 1 and n_words > 0").count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(2)
    field = quality.Field(r.normal(size=(sum(quality.VALUES), 2)), r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 8):
        feats = [[o + int(r.integers(v)) for o, v in zip(quality.OFFSETS, quality.VALUES)] for _ in range(n)]

        def total(path, feats=feats):
            return field.first[path[0]] + sum(field.emit[f, y].sum() for f, y in zip(feats, path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))

        assert total(field.decode(feats)) == pytest.approx(max(total(p) for p in itertools.product((0, 1), repeat=n)))


def test_token_counts_match_the_public_tokenizer(spark):
    from tokenizers import Tokenizer, models, normalizers

    vocabulary = tokens.Vocabulary.load()
    texts = [None, "", " ", "a  b   c", "Hello world, hello", "𝒳𝒴 日本語 \n\tq", "aaaaaaaa", "<0x41> x", "x" * 5000]
    filler = [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    public = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.pieces.items(), *filler], 0, True))
    public.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = {x.doc_id: x for x in tokens.count_tokens(docs_of(spark, texts), vocabulary).collect()}
    for i, t in enumerate(texts):
        if t != "<0x41> x":  # there the byte pieces of the file would match as text
            assert got[i].n_tokens == (len(public.encode(t).ids) if t else 0), t
    tied = tokens.Vocabulary({"▁": 0.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -1.0, "c▁": -1.0}, False)
    own = Tokenizer(models.Unigram([("<unk>", 0.0), *tied.pieces.items()], 0, False))
    own.normalizer = public.normalizer
    for t in ("ab", "abab ab", "xyab", "xy zab", "c c"):
        assert tokens.Counter(tied).count(t)[0] == len(own.encode(t).ids), t
