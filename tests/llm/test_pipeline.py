"""The pipeline's stages against brute force on what each was given."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import brute as B
import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            kept = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            fine = {i for i, t in given if (b := B.base_rules(t))[0] >= 20 and 100 * b[4] <= 30 * b[0]}
            assert set(kept) <= fine and len(kept) >= 0.95 * len(fine)
        elif k == 1:
            assert set(kept) == {i for i, c in B.classes({i: B.shingles(t) for i, t in given}).items() if i == c}
        elif k == 2:
            want = B.removed(given)
            assert {i for i, t in given if kept[i] != t} == {i for i, w in want.items() if w[1]}
        elif k == 3:
            assert not any(B.personal(t) for t in kept.values())
        else:
            assert {r.doc_id for r in docs.collect()} == {i for i, _ in given}


def test_awkward_rows_and_empty_tables(spark):
    line = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near a quiet river bank at dawn "
    rows = [(None, " ".join(reversed(line.split())), None), (1, None, "en"), (2, "", "en"), (3, line + "write to a@b.eu", "en"), (3, line + "write to a@b.eu", "en"), (4, line + "write to a@b.eu", "en"), (3, None, "en"), (5, "word " * 30000, "en"), (None, None, None)]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node long")
    want = {"quality rules": [None, 3, 3, 4], "n-gram Jaccard join": [None, 1, 2, 3, 3, 3, 5, None], "suffix-array dedup": [r[0] for r in rows], "PII": [r[0] for r in rows]}
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name in want:
            got = out.collect()
            assert out.columns == docs.columns and {r.node for r in got} == {7}
            assert order(r.doc_id for r in got) == order(want[name]), name
        else:
            assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4, 5}


def test_links_contract_in_few_jobs(spark):
    """Every job leaves events and plans on the driver: stars are done at once, a long path in rounds that grow with its logarithm."""
    from hammerline.llm._spark import components

    r = random.Random(5)
    cases = {"stars": [(10 * i, 10 * i + j) for i in range(50) for j in range(1, 5)], "none": [], "loop": [(4, 4)]}
    cases |= {"path": [(i, i + 1) for i in range(200)], "random": [(r.randrange(300), r.randrange(300)) for _ in range(200)], "two parents": [(1, 3), (2, 3)]}
    for name, edges in cases.items():
        want = {x: x for e in edges for x in e if e[0] != e[1]}
        while any(want[a] != want[b] for a, b in edges if a != b):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        spark.sparkContext.setJobGroup(name, name)
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(got) == len(want) and {x.node: x.comp for x in got} == want, name
        assert jobs <= {"path": 90, "random": 50, "two parents": 30}.get(name, 10), (name, jobs)


def test_small_tables_are_read_in_few_tasks(spark):
    """A task has a cost of its own, so a join of few texts in many parts must not have parts times steps of them."""
    from hammerline.llm._spark import cut_to_tasks
    from hammerline.llm.jaccard_join import jaccard_components

    parts, conf = 64, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = [(i, f"text {i}" if i % 3 else None, b"x" * i, i / 2) for i in range(200)]
        table = spark.createDataFrame(rows, "a long, b string, c binary, d double").repartition(parts)
        small = cut_to_tasks(table)
        assert small.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert sorted((r.a, r.b, bytes(r.c), r.d) for r in small.collect()) == rows
        assert cut_to_tasks(table.where("a < 0")).count() == 0
        wide = spark.range(parts, numPartitions=parts).select("id", F.repeat(F.lit("x"), 2 << 20).alias("s"))
        assert spark.sparkContext.defaultParallelism < cut_to_tasks(wide).rdd.getNumPartitions() <= 17

        r = random.Random(6)
        base = [" ".join(str(r.randrange(9999)) for _ in range(60)) for _ in range(10)]
        docs = [(i, base[i % 10] + " end" * (i % 3)) for i in range(60)]
        spark.sparkContext.setJobGroup("tasks", "tasks")
        got = {x.doc_id: x.component_id for x in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
        assert got == B.classes({i: B.shingles(t) for i, t in docs})
        assert tasks < 5_000, tasks
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)


def test_filters_come_packed_to_the_driver(spark):
    from hammerline.llm import suffix_dedup as S

    values = [0, 1 << 40, (1 << 63) - 1, -1, -(1 << 50)]
    bits = S._bit_filter(spark.createDataFrame([(v,) for v in values], "a long"), "a")
    at = {(v % (1 << 64)) >> (64 - S.FILTER_BITS) for v in values}
    assert set(np.flatnonzero(np.unpackbits(bits)).tolist()) == at and len(bits) == 1 << (S.FILTER_BITS - 3)
    assert len(S._packed(np.zeros(1 << 21, bool))) < 10_000


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
