import pyarrow as pa
import os

import corpus_pipeline
import pytest

from termgauge.llm import decontam, jaccard

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
        kept[name] = [r.doc_id for r in out.select("doc_id").distinct().collect()]
    assert len(kept["language"]) > 180 and kept["near_duplicates"] != kept["language"]
    assert sorted(kept["packing"]) == sorted(kept["benchmark"])


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    one = corpus_pipeline.near_duplicate_stage(spark, docs, SF_DIR)
    groups = {r.component_id for r in jaccard.jaccard_groups(one, k=5, percent=80).collect()}
    assert len(groups) == one.count() < docs.count()
    clean = corpus_pipeline.benchmark_stage(spark, one, SF_DIR)
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert decontam.find(clean, benchmark).count() == 0


def test_nulls_empty_and_extra_columns(spark):
    rows = [(1, None, None, 1), (None, "", "en", 2), (2, "der die das und ist", "de", 3), (2, "der die das und ist", "de", 3)]
    schema = "doc_id long, text string, lang string, score int"
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    docs.collect()
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_batches_are_small_within_and_as_before_after(spark):
    from termgauge.session import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    rows = spark.range(3000).selectExpr("repeat('x', 4000) AS t").repartition(1)
    before = spark.conf.get(key)
    with small_batches(spark, "1m"):
        small = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(small) == 3000 and max(small) < 600 and spark.conf.get(key) == before


def test_workers_give_memory_back(spark):
    from termgauge.llm.memory import freed

    def resident():
        with open("/proc/self/status") as status:
            return next(int(line.split()[1]) // 1024 for line in status if line.startswith("RssAnon"))

    def run(batches):
        before = resident()
        for batch in batches:
            held = [bytes(1000) for _ in range(200_000)]
            most = resident()
            kept, held = held[::5000], None  # the last of them holds the top of the heap
            yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([most])], ["before", "most"])

    def after(batches):
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([resident()])], ["before", "most"])

    both = lambda batches: after(freed(run)(batches))
    rows = {r.before: r.most for r in spark.range(1).repartition(1).mapInArrow(both, "before long, most long").collect()}
    last = rows.pop(-1)
    ((before, most),) = rows.items()
    assert most > before + 150 and last < before + 100
