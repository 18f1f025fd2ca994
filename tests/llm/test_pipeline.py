"""The pipeline, stage by stage, against brute force on each stage's own input."""

import time
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from graphmill import session
from graphmill.llm import mixing, packing, quality
from graphmill.llm.common import shipped

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    shipped(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{k}"))
        docs = seen[name][1]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]

    before, after = seen["quality rules"]
    model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = {r["doc_id"]: r["kept"] for r in quality.score(before, model).collect()}
    assert rows(after) == [x for x in rows(before) if verdict[x[0]]]
    assert not any(brute.base(t)["base_failed"] for _, t in rows(after))

    before, after = seen["near-duplicates"]
    found = brute.near(rows(before), width=5)
    assert rows(after) == [x for x in rows(before) if found[x[0]][1] == x[0]]

    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = brute.contaminated(rows(before), items)
    assert rows(after) == [x for x in rows(before) if not dirty[x[0]][4]]

    before, after = seen["mixing"]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect() if r["taken"]}
    words, whole = {}, dict(rows(before))
    for d, text in rows(after):
        own = brute.WORD.findall(text)
        words[d] = words.get(d, 0) + len(own)
        assert " ".join(own) in " ".join(brute.WORD.findall(whole[d]))
    assert words == taken

    before, after = seen["packing"]
    encode = packing.encoder(f"{packing.TOKENIZERS}/{packing.VOCABULARY}").encode_ordinary
    total = sum(len(encode(t)) for _, t in rows(before))
    packed = after.collect()
    assert sum(r["n_tokens"] for r in packed) == total
    assert sum(len(ids) for _, _, ids in packing.segments_of(packed)) == total


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shuffle_files_go(spark):
    folders = [x.toString() for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for x in folders for f in Path(x).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(session.CLEANUP)
    out = session.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 7
    assert spark.conf.get(session.CLEANUP) == setting
