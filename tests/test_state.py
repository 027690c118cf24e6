"""Completion of jobs by six counts, over one batch and several, with rows in any order."""

import random

import pytest
from pyspark.sql import functions as F

from sparkquill.sources.tables import held, own_path, read, release
from sparkquill.streaming import events, state

DIR = "/root/testdata/sf0.001"


def folded(rows):
    """(job, seq, counts) of the first row, in order of time, after which all counts agree."""
    out, jobs = {}, {}
    for job, at, seq, kind, citation in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if job in out:
            continue
        facts = jobs.setdefault(job, set())
        facts |= {(k, citation) for k in (("run", "run_done") if kind == "run_done" else (kind,))}
        known = {c for k, c in facts if k == "citation"}
        n = {state.KIND_OF[k]: sum((k, c) in facts for c in known) for k in state.KIND_OF}
        if known and n["total"] == n["existence"] == n["proposition"] and n["quotes"] == n["quoted"] and n["runs"] == n["runs_done"]:
            out[job] = (seq, tuple(n[c] for c in state.COUNTS))
    return out


def run(spark, path, rows, files, monkeypatch):
    monkeypatch.setattr(events, "FILES", 1)
    for part in range(files):
        mine = [r for i, r in enumerate(rows) if i % files == part]
        spark.createDataFrame(mine, state.FACTS).coalesce(1).write.mode("append").parquet(path)
    source = lambda: spark.readStream.schema(state.FACTS).option("maxFilesPerTrigger", 1).parquet(path)
    got = state.completions(source, own_path(spark, "completion-test"), "400 days").collect()
    assert len({r.job for r in got}) == len(got)
    return {r.job: (r.seq, tuple(r[c] for c in state.COUNTS)) for r in got}


@pytest.mark.parametrize("files", [1, 4])
def test_completion_however_batches_cut_the_rows(spark, tmp_path, monkeypatch, files):
    """Rows are dealt to the batches at random, so most of them come late."""
    facts = events.job_facts(read(spark, DIR, "events").withColumn("at", F.col("ts").cast("timestamp")))
    rows = [tuple(r) for r in facts.select("job", "at", "seq", "kind", "citation").collect()]
    want = folded(rows)
    random.Random(files).shuffle(rows)
    rows += rows[:50]  # what comes twice counts once
    assert run(spark, f"{tmp_path}/facts", rows, files, monkeypatch) == want and len(want) > 2


def test_a_job_is_told_once_and_waits_for_its_answers(spark, tmp_path, monkeypatch):
    t = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    answers = lambda job, c, s: [(job, t(s), s, "existence", c), (job, t(s), s, "proposition", c)]
    rows = [(1, t(0), 0, "citation", 7), *answers(1, 7, 5), (1, t(9), 9, "citation", 8), *answers(1, 8, 12)]  # complete at 5; what follows changes nothing
    rows += [(2, t(0), 0, "citation", 7), (2, t(1), 1, "quote", 7), *answers(2, 7, 5), (2, t(6), 6, "run", 7), (2, t(8), 8, "quoted", 7), (2, t(20), 20, "run_done", 7)]
    rows += [(3, t(0), 0, "citation", 7), *answers(3, 7, 5)[:1], (4, t(1), 1, "existence", 1), (4, t(1), 2, "proposition", 1), (4, t(3), 3, "citation", 1)]
    rows += [(None, t(0), 0, "citation", 1), (5, None, 0, "citation", 1), (5, t(0), 0, None, 1)]
    assert {k: v[0] for k, v in run(spark, f"{tmp_path}/facts", rows, 2, monkeypatch).items()} == {1: 5, 2: 20, 4: 3} == {k: v[0] for k, v in folded(rows[:-3]).items()}


def test_results_of_streams_can_be_removed(spark):
    before = held(spark)
    assert events.streaming_dedupe(spark, DIR).count() and len(held(spark)) == len(before) + 1
    release(spark, [p for p in held(spark) if p not in before])
    assert held(spark) == before
