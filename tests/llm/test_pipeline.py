"""The pipeline against its stages by brute force, on the smallest table."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from paperledger.llm import scratch, shingle_join
from tests.llm.test_operators import brute_components, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs.orderBy("doc_id").collect())
        docs = scratch.table(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
    given, good, single, spread, mixed = seen
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in good}
    assert len(bad - kept) >= 0.9 * len(bad) and len(clean & kept) >= 0.97 * len(clean)
    first = {}
    for r in good:
        first.setdefault(" ".join((r.text or "").encode().decode().split()), r.doc_id)
    assert {r.doc_id for r in single} == set(first.values())
    roots = brute_components([r.text for r in single])
    assert [r.doc_id for r in spread] == [single[i].doc_id for i in sorted({c for _, c in roots})]
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in spread}
    assert {r.text for r in mixed} <= {r.text for r in given}
    pieces = defaultdict(int)
    for r in docs.collect():
        pieces[r.doc_id] += r.length / r.doc_tokens
    counts = defaultdict(int)
    for r in mixed:
        counts[r.doc_id] += 1
    assert {k: round(v) for k, v in pieces.items()} == dict(counts)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_of_null_and_repeated_ids(spark):
    base = [[f"{name}{i}" for i in range(60)] for name in "abcd"]
    near = [" ".join([*x[:-1], "end"]) for x in base]
    a, b, c, d = (" ".join(x) for x in base)
    rows = [(None, a), (None, "a clean text that links with no other one"), (None, ""), (None, None), (4, near[0]), (None, b), (None, near[1]), (3, c), (5, c + " more"), (5, d), (9, near[3]), (6, None), (6, "")]
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", 1, None, 7) for i, t in rows], table(spark, []).schema)
    left = shingle_join.drop_near_copies(docs.repartition(3))
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    one = [x for x in got if x in ((None, b), (None, near[1]))]
    assert len(one) == 1
    assert got == sorted([rows[1], rows[2], rows[3], rows[4], one[0], rows[7], rows[9], rows[11], rows[12]], key=repr)


def test_stages_keep_null_ids(spark, tmp_path):
    """The same texts with and without ids: every stage up to the mix leaves the same, near copies of null ids apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    some = F.col("doc_id") % 7 != 3
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    given = docs.withColumn("doc_id", F.when(some, F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = given
        given = scratch.table(stage(spark, given, str(tmp_path)), f"null-{name}")
        assert given.where("doc_id IS NULL").count() > 0
        if name == "near_dedup":
            rows = before.orderBy(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "text").collect()
            roots = brute_components([r.text for r in rows])
            assert sorted(r.text or "" for r in given.collect()) == sorted(rows[i].text or "" for i in {c for _, c in roots})
    mixed = scratch.table(corpus_pipeline.mix_sources(spark, given, str(tmp_path)), "null-mix")
    assert {r.text for r in mixed.collect()} <= {r.text for r in given.collect()}
    assert mixed.where("doc_id IS NULL").count() > 0
    pieces = corpus_pipeline.pack_sequences(spark, mixed, str(tmp_path))
    whole = pieces.groupBy(F.col("doc_id").isNull()).agg(F.sum(F.col("length") / F.col("doc_tokens")).alias("n")).collect()
    assert sorted(round(r.n) for r in whole) == sorted([mixed.where("doc_id IS NULL").count(), mixed.where("doc_id IS NOT NULL").count()])
