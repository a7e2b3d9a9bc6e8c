"""The whole run on planted documents, and every stage on empty and odd tables."""

import random
import zlib

import corpus_pipeline
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(4)
    root = str(tmp_path_factory.mktemp("sf"))
    item = words(r, 14)
    texts = {i: words(r, 90) for i in range(300)}
    toxic = {i for i in range(300) if i % 6 == 0}
    for i in toxic:
        texts[i] += " vilew nastyx " + words(r, 5)
    copies = {301: 7, 302: 7, 303: 11}
    for i, of in copies.items():
        texts[i] = texts[of]
    texts[304] = words(r, 40) + " " + item.upper() + ", " + words(r, 40)
    texts[305] = words(r, 30) + " call +1 (386) 555-3733 or me@mail.example.org " + words(r, 30)
    texts[306], texts[307], texts[308] = None, "", None
    rows = [(i, t, "en", "big" if i % 3 else None, len(t) if t is not None else None) for i, t in texts.items()] + [(None, words(r, 50), None, None, None)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts, toxic


def test_run_on_planted_documents(spark, planted):
    root, texts, toxic = planted
    got = corpus_pipeline.run(spark, root).collect()
    kept = {x.doc_id: x.text for x in got}
    clean = {i for i in texts if i not in toxic} - {301, 302, 303, 304}
    assert len(got) == len(kept) and set(kept) == clean | {None}
    changed = {i for i in clean if kept[i] != texts[i]}
    assert changed == {305} and "[PHONE]" in kept[305] and "[EMAIL]" in kept[305] and "@" not in kept[305]
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in got)
    assert len({(x.mix_slot, x.mix_place) for x in got}) == len(got)
    assert sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in toxic) > 5  # held-out toxic documents went too


def test_stages_on_empty_and_odd_tables(spark, planted):
    root, _, _ = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(5, "same words", "en", "a", 10)] * 3, DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), root).count() == 0, name
        out = stage(spark, odd, root)
        assert out.filter("text is null").count() == 2 and out.filter("doc_id = 5").count() == (1 if name == "simhash_near_dedup" else 3), name
        assert name == "mixing" or out.columns == docs.columns
    bare = docs.withColumn("score", docs.lang).withColumn("fp", docs.lang).withColumn("mix_slot", docs.lang).withColumn("pii_spans", docs.lang)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, bare.limit(3), root).count() == 3, name
