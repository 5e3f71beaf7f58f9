"""The pipeline's stages, each against what a plain reading of its input gives."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftmark.llm import mixing, quality
from test_operators import brute_components, brute_hits, words


def test_stages(spark, tiny):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    extra = table.where("doc_id < 40").unionByName(table.where("doc_id = 50").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(table.limit(0))
    docs, seen = table.unionByName(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, tiny)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == table.columns
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    before, after = seen["quality rules"]
    judged = {(r["doc_id"], r["text_hash"]): r["kept"] for r in quality.judge(before, spark.read.parquet(f"{tiny}/labels.parquet")).collect()}
    hashed = before.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    assert sorted(map(repr, rows(after))) == sorted(repr((r["doc_id"], r["text"])) for r in hashed if judged[r["doc_id"], r["h"]])
    assert all(len((t or "").split()) >= 50 for _, t in rows(after)) and 0 < after.count() < before.count()  # the tables have ASCII blanks only
    before, after = seen["near duplicates"]
    numbered = list(enumerate(rows(before)))
    comps = brute_components([(i, t) for i, (_, t) in numbered])
    groups = collections.defaultdict(list)
    for i, (d, t) in numbered:
        groups[comps[i]].append((d is None, d, t))
    assert sorted(map(repr, rows(after))) == sorted(repr(min(g, key=lambda x: (x[0], x[1] or 0))[1:]) for g in groups.values())
    before, after = seen["decontamination"]
    items = [(str(r["item_id"]), words(r["text"])) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert sorted(map(repr, rows(after))) == sorted(repr(x) for x in rows(before) if not brute_hits(x[1], items)[1])
    before, after = seen["mixing"]
    copies = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()})
    assert collections.Counter(d for d, _ in rows(after)) == +copies
    before, after = seen["sharding"]
    assert before.count() == after.count() and len({(r["shard"], r["slot"]) for r in after.collect()}) == after.count()


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_nothing(spark, tiny, stage):
    empty = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, empty, tiny).count() == 0
