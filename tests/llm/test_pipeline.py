"""The pipeline's stages on a small corpus with planted cases, against plain versions of each decision."""

import random

import corpus_pipeline
from faintline.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(20) for _ in range(5)]
    docs = {i: text(rnd.randint(30, 90)) for i in range(300)}
    toxic = set(range(0, 300, 6))
    for i in toxic:
        docs[i] += " wretchedscum " + text(3)
    for i in range(1, 100, 10):
        if i not in toxic:
            docs[i] += " mail me at someone@example.org or 10.0.0.1 now"
    copies = {}
    for i in range(5, 200, 25):
        if i not in toxic:
            copies[1000 + i] = i
            docs[1000 + i] = docs[i] + " " + word()
    leaks = set()
    for k, i in enumerate(range(203, 290, 20)):
        if i not in toxic:
            docs[i] += " " + items[k % 5].upper() + "."
            leaks.add(i)
    docs[5000], docs[5001] = "", None
    return docs, toxic, copies, leaks, items


def test_stages(spark, tmp_path):
    docs, toxic, copies, leaks, items = corpus()
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = set(docs)
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:-1], (toxic, set(copies), leaks, set()), strict=True):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        want -= gone
        got = {r.doc_id: r for r in now.collect()}
        assert set(got) == want, name
    for i, r in got.items():
        if "@" in (docs[i] or ""):
            assert "[EMAIL]" in r.text and "[IP]" in r.text and "@" not in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == docs[i]
    assert pii.report(now).filter("spans <> ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == want
    again = {(r.doc_id, r.piece, r.bin_offset) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.piece, r.bin_offset) for r in packed}
