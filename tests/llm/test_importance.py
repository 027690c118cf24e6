"""Importance resampling against plain Python, over one block and many, with runs of one word and of several."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sparkquill.llm import importance
from test_corpus import CLASHES, SCHEMA, lower, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(docs, target, runs, buckets, least, share):
    def buckets_of(t):
        w = WORD.findall(lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    each = [(i, *buckets_of(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in buckets_of(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in each:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * share // 100]
    return sorted(((r[0], r[2], r[3], r[4]) for r in out), key=repr), [(r[0], r[4]) for r in drawn]


def check(got, want, drawn):
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == want
    ranks = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert [r[0] for r in ranks] == list(range(1, len(drawn) + 1)) and [(i, s) for _, i, s in ranks] == drawn


@pytest.mark.parametrize("runs, buckets, least, share", [(1, 10_000, 20, 10), (2, 512, 0, 50), (3, 1 << 16, 1, 100)])
def test_against_plain_python(spark, monkeypatch, runs, buckets, least, share):
    monkeypatch.setattr(importance, "SORTED", 7)
    rows = [(i, t) for i, t, _ in texts()] + [(200 + k, " ".join(f"word{(k * j) % 17} Ünï{j % 5}" for j in range(k % 40))) for k in range(200)]
    target = ["word1 word2 word3 ünï1", None, "", "hello world"]
    docs = spark.createDataFrame([(i, t, None, "s", 0, *CLASHES) for i, t in rows], SCHEMA).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.importance_sample(docs, aim, runs=runs, buckets=buckets, least=least, share=share).collect()
    check(got, *by_hand(rows, target, runs, buckets, least, share))


def test_rows_that_are_alike_are_dealt_to_several_tasks(spark, monkeypatch):
    """A thousand rows of one id and one text have a thousand ranks of their own."""
    monkeypatch.setattr(importance, "SORTED", 50)
    rows = [(7, "many words " * 15)] * 1000 + [(8, "other words " * 15)] * 10
    aim = spark.createDataFrame([("words",)], "text string")
    got = importance.importance_sample(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), aim, share=50).collect()
    assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, 506))


def test_empty_tables(spark):
    none, aim = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert importance.importance_sample(none, aim).collect() == []
    one = spark.createDataFrame([(1, None), (2, "a b")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in importance.importance_sample(one, aim).collect()}
    assert rows[1].n_features == rows[1].weight == 0 and rows[1].rank is None and rows[2].n_features == 2


def test_bucket_numbers_have_to_fit(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        importance.importance_sample(docs, docs, buckets=(1 << 16) + 1)
