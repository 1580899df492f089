"""The pipeline's stages, each judged on its own input."""

import re
from collections import Counter

import corpus_pipeline
from usagelake.llm.decontaminate import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = f"{tmp_path}/{i}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        a, b = ({tuple(r) for r in x.select(COLUMNS).collect()} for x in (docs, after))
        assert b <= a, name
        if name != "sharding":
            assert after.columns == COLUMNS
        if name == "near_duplicates":
            texts = Counter(r[1] for r in b)
            assert max(texts.values()) == 1 and len(b) > 0.8 * len(a)
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate(after, bench).filter("decontamination.contaminated").count() == 0
        if name == "sharding":
            assert after.count() == docs.count() and {r["shard"] for r in after.select("shard").distinct().collect()} == {*range(8)}
        docs = after


def test_mixing_follows_targets(spark, sf):
    from usagelake.llm.mixing import taken_copies

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = lambda rows: sum(len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in rows)
    before, after = docs.collect(), taken_copies(docs).collect()
    assert abs(n(after) / n(before) - 1.5) < 0.15
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_one_of_each_group_stays(spark):
    """Also of rows that are there twice, of texts that share an id, and of null ids; other columns keep their names."""
    from usagelake.llm.near_duplicates import keep_one

    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t), (1, t), (2, t), (7, t + " x"), (7, t + " y"), (None, t), (5, "a b"), (5, "a b"), (None, "c d e"), (None, "c d e"), (9, None), (9, None), (8, "")]
    docs = spark.createDataFrame([(i, x, "en") for i, x in rows], "doc_id long, text string, _near_key string")
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, t), (5, "a b"), (None, "c d e"), (9, None), (9, None), (8, "")])


def test_mixing_keeps_columns_of_any_name(spark):
    from usagelake.llm.mixing import taken_copies

    docs = spark.createDataFrame([(i, f"a b c {i}", "s", i, "x", 1) for i in range(40)], "doc_id long, text string, source string, _s long, _copy string, _mix_id int")
    got = taken_copies(docs)
    assert got.columns == docs.columns and {r["_s"] == r["doc_id"] and r["_copy"] == "x" for r in got.collect()} == {True}
    assert abs(got.count() - 60) <= 1


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
