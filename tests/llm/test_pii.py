import hashlib
import re

from gleanery.llm import pii
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, m):
    digits = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


TEXTS = [
    None, "", "a@b.cc_d@e.ff x", "a.b@c d@e.f", "𝒳é a@b.co 𝒴 x@y.zz", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 0000000000000000000001.1.1.1 1.2.3.99999999999999999999",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111222233 1 2", "+1 (386) 555-3733 +1234567 +12345678901234567 +9 ((((", "a" * 2000, "1" * 2000,
    "x@" * 500, "é" + "q@r.st " * 700 + "end", "+44 10.20.30.40 mail +4915112345.x@h.de", "a@b.c-.d.e@f.gg x@y.zz\nno@nl.aa",
]


def test_base_spans_match_plain_patterns(spark):
    rows = [(i, t, "v") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again"), (None, TEXTS[6], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    got = pii.digest(pii.find_spans(docs)).collect()
    want = sorted((str(i), *[sum(s[0] == k for s in base_spans(t)) for k in PLAIN], sha(base_spans(t))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.digest(pii.find_spans(docs.limit(0))).count() == 0


def test_disclosing_terms_are_found_and_removed(spark):
    own = [f"Word{'abcdefgh'[i]} lives near zephyrion and bob@home.org in town{'abcdefgh'[i]} often" for i in range(6)]
    other = [f"plain words stand here in number {'x' * (i + 3)} and near the town often" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(own + other + ["say Zephyrion twice, zephyrion"])], "doc_id long, text string")
    terms = {r.term: r for r in pii.disclosing_terms(docs).collect()}
    assert set(terms) == {"zephyrion", "lives"}
    # six of the seven texts with the term name the entity; N = 67
    import math
    assert abs(terms["zephyrion"].share - (1 + math.log2(6 / 7) / math.log2(67 / 6))) < 1e-9 and terms["zephyrion"].action == "generalise"
    assert terms["lives"].share == 1.0 and terms["lives"].action == "remove"
    for limit in (100_000, 0):  # broadcast and shuffled term tables give the same
        out = {r.doc_id: r for r in pii.redact(pii.find_spans(docs, max_broadcast=limit)).collect()}
        assert out[66].text == "say [TERM] twice, [TERM]"
        assert out[0].text == "Worda  near [TERM] and [EMAIL] in towna often"
        assert all(out[6 + i].text == t for i, t in enumerate(other))


def test_copies_of_one_text_disclose_nothing(spark):
    docs = spark.createDataFrame([(i, "rareword names eve@x.org always") for i in range(50)] + [(99, "other")], "doc_id long, text string")
    assert pii.disclosing_terms(docs).count() == 0


def test_redaction_merges_overlaps_in_long_texts(spark):
    text = ("lorem ipsum " * 700 + "+44 10.20.30.40 é ") * 3 + "z@y.xx"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(pii.find_spans(docs)).collect()}
    assert got[1] == ("lorem ipsum " * 700 + "[PHONE] é ") * 3 + "[EMAIL]" and got[2] == "clean" and got[3] is None


def test_prefix_sums(spark):
    rows = [([5],), ([1, 2, 3],), (list(range(1, 102)),)]
    df = spark.createDataFrame(rows, "a array<long>").withColumn("b", pii.block_sums(F.col("a")))
    df = df.select("a", F.transform("a", lambda _, i: pii.prefix_sum(F.col("a"), F.col("b"), i + 1)).alias("p"))
    for r in df.collect():
        assert r.p == [sum(r.a[: i + 1]) for i in range(len(r.a))]
