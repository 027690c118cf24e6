"""The toxicity network against a plain forward pass, its thresholds, its sample's bound, and held-out labels."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkquill.llm import toxicity
from test_corpus import CLASHES, SCHEMA, texts

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))


def plain_parts(word):
    """Buckets by whole numbers, one letter at a time."""
    top = (1 << 32) - 1

    def bucket(h, salt):
        h = ((h ^ (salt * 0x9E3779B1 & top)) * 0x85EBCA6B) & top
        h = ((h ^ h >> 13) * 0xC2B2AE35) & top
        return (h ^ h >> 16) >> 32 - toxicity.BITS

    def rolled(s):
        h = 0
        for c in s:
            h = (h * 16777619 + ord(c)) & top
        return h

    marked = f"<{word}>"
    return bucket(rolled(marked), 1), [bucket(rolled(marked[i : i + n]), n) for n in toxicity.SIZES for i in range(len(marked) - n + 1)]


def test_hashed_parts_by_hand():
    words = ["a", "no", "scum", "ünïcode", "x" * 30, "漢字😀"]
    buckets, first, whole = toxicity.parts(words)
    ends = [*first[1:].tolist(), len(buckets)]
    for w, lo, hi, n in zip(words, first.tolist(), ends, whole.tolist()):
        one, runs = plain_parts(w)
        assert n == one and sorted(buckets[lo:hi].tolist()) == sorted([one, *runs])


def test_scores_as_a_plain_forward_pass(model, monkeypatch):
    """Log-odds by loops over words and filters, over one stretch and many; a text's score doesn't depend on those beside it."""
    cases = ["You are such an idiot, really.", "The and of.", "", "x", "Der Tag ist schön. " * 20, " ...! "]

    def one(net, words):
        vectors = [net.embed[[plain_parts(w)[0], *plain_parts(w)[1]]].astype(float).mean(axis=0) for w in words]
        z = float(net.base[0])
        for f in range(net.filters.shape[2]):
            top = max(
                (sum(float(vectors[i + j] @ net.filters[j, :, f].astype(float)) for j in range(toxicity.WIDEST) if i + j < len(words)) for i in range(len(words))), default=0.0
            )
            z += max(0.0, top + float(net.bias[f])) * float(net.out[f])
        return z

    want = []
    for t in cases:
        words = re.findall(r"[^\W_]+", t.lower())
        z = sum(one(net, words) for net in model.networks) / len(model.networks)
        limit = model.all
        if words:
            limit = model.thresholds[int(np.argmax([sum(float(model.table[plain_parts(w)[0], k]) for w in words) for k in range(len(model.names))]))]
        want.append(1 / (1 + math.exp(limit - z)))
    assert np.allclose(model.scores(pa.array(cases)), want, atol=1e-4)
    monkeypatch.setattr(toxicity, "AT_ONCE", 3)
    assert np.allclose(model.scores(pa.array(cases)), want, atol=1e-4)
    assert np.allclose([model.scores(pa.array([t]))[0] for t in cases], want, atol=1e-4)


def test_threshold_has_the_best_f1():
    draw = np.random.default_rng(3)
    for _ in range(50):
        z, y = draw.integers(-5, 6, 40).astype(float), (draw.random(40) < 0.4).astype(float)
        if not y.any():
            continue
        f1 = lambda t: 2 * ((z >= t) & (y == 1)).sum() / ((z >= t).sum() + y.sum())  # noqa: E731, B023
        assert f1(toxicity.best_threshold(z, y)) == max(f1(t) for t in np.unique(z))


def test_held_out_labels(spark):
    """On held-out documents, nine of ten verdicts on toxic texts of words that were learned hold, and clean ones are left alone."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).where("held_out").collect()}
    known = [(r.toxic, rows[r.doc_id]) for r in labels.where("toxic is not null").collect() if r.doc_id in rows]
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for _, r in known)
    assert np.mean([r.predicted for y, r in known if y == 1]) >= 0.8 and np.mean([r.predicted for y, r in known if y == 0]) <= 0.02


def test_odd_rows(spark, model, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *a: model)
    rows = [(i, t, g, "s", 0, *CLASHES) for i, t, g in [*texts(), (300, "the of idiot and scum in that was moron it is " * 20_000, "en"), (301, "y" * 300_000, None)]]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA).repartition(3), None).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    by_text = {r.doc_id: r.score for r in got}
    assert by_text[6] == by_text[7] == by_text[8] and by_text[300] > 0.5
    assert toxicity.score_toxicity(spark.createDataFrame([], SCHEMA), None).collect() == []


def test_sample_keeps_its_bound_and_leaves_out_what_is_held_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TEXTS_EACH", 10)
    monkeypatch.setattr(toxicity, "STRETCH", 4)
    monkeypatch.setattr(toxicity, "STRETCHES", 2)
    docs = spark.createDataFrame([(k, f"text of number {k} " * (k % 5), "en") for k in range(200)] + [(1, "twice", None)] * 50, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1, 1)] * 30 + [(2, None)], "doc_id bigint, toxic int")
    rows = toxicity.sample(docs.repartition(4), labels, "doc_id", "text", "lang", "toxic")
    assert sum(y for y, _, _ in rows) == 10 and len(rows) == 20 and all(len(w.split()) <= 8 for _, _, w in rows)
    out = [r[0] for r in docs.where(toxicity.held_out("doc_id")).select("doc_id").distinct().collect()]
    assert out and not {w.split()[3] for _, _, w in rows if len(w.split()) > 3} & {str(k) for k in out}


@pytest.mark.parametrize("given, score", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_nothing_to_learn(spark, given, score):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c d", "en"), (3, None, None)], "doc_id bigint, text string, lang string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(given, "doc_id bigint, toxic int")).collect()
    assert len(got) == 3 and {r.score for r in got} == {score}


def test_words_and_thresholds_come_from_all_labelled_texts(spark, monkeypatch):
    """With a sample of 20 texts, what only the others say is learned: a language's words, its threshold, and a toxic word; parts in any order give the same."""
    monkeypatch.setattr(toxicity, "TEXTS_EACH", 10)
    monkeypatch.setattr(toxicity, "TOGETHER", 500)
    draw = np.random.default_rng(4)
    words = np.array("rain stone green light paper river under seven little house".split())
    said = [" ".join(draw.choice(words, 12)) + f" {'grumbix' if k % 4 == 0 else 'flower'} g{k % 2}" for k in range(1500)]
    docs = spark.createDataFrame([(k, t, f"g{k % 2}") for k, t in enumerate(said)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1500)], "doc_id bigint, toxic int")
    seen = []
    real = toxicity.Model.__init__
    monkeypatch.setattr(toxicity.Model, "__init__", lambda self, nets, counts, tallies: seen.append((counts, tallies)) or real(self, nets, counts, tallies))
    models = [toxicity.train(d, labels) for d in (docs.repartition(3), docs.repartition(7))]
    known = [r[0] for r in docs.where(~toxicity.held_out("doc_id")).select("doc_id").collect()]
    counts, tallies = seen[0]
    assert {g: int(c.sum()) for g, c in counts.items()} == {g: 14 * sum(k % 2 == int(g[1]) for k in known) for g in ("g0", "g1")}
    assert sum(t[2] for t in tallies) == len(known) and sum(t[3] for t in tallies) == sum(k % 4 == 0 for k in known)
    got = [m.scores(pa.array(said)) for m in models]
    assert (got[0] == got[1]).all() and ((got[0] >= 0.5) == (np.arange(1500) % 4 == 0)).mean() > 0.99


def test_words_of_a_chunk_are_numbered_once(monkeypatch):
    """The words of all texts of a chunk are hashed together, and each text has the words and parts that it has alone."""
    given, calls, real = ["a scum no a", "", "no ünïcode scum", " ... "], [], toxicity.parts
    alone = [toxicity.numbered(pa.array([t])) for t in given]
    monkeypatch.setattr(toxicity, "parts", lambda words: calls.append(words) or real(words))
    got = list(toxicity.each_text(pa.array(given)))
    assert len(calls) == 1
    spread = lambda buckets, first, words: [np.split(buckets, first[1:])[w].tolist() for w in words]
    for (buckets, first, words, whole), (n, _, b, f, w) in zip(got, alone, strict=True):
        assert spread(buckets, first, words) == spread(b, f, n) and whole[words].tolist() == w[n].tolist()


def test_a_step_by_many_texts_is_the_mean_of_steps_by_each():
    said = ["you scum of the earth", "a green house", "", "little rain on the river and no more of it", "x"]
    texts, y = list(toxicity.each_text(pa.array(said))), np.array([1.0, 0, 1, 0, 0])
    learner = lambda: toxicity.Learner(toxicity.Network(), 0.4, 0.01)
    together, each = learner(), [learner() for _ in said]
    together.learn(texts, y)
    for one, t, label in zip(each, texts, y):
        one.learn([t], np.array([label]))
    for name in toxicity.NAMES:
        assert np.allclose(together.mean[name], np.mean([e.mean[name] for e in each], axis=0), atol=1e-7) and together.mean[name].any()


def test_each_part_is_a_task_of_its_own(spark):
    rows = spark.range(4000).selectExpr("xxhash64(id) AS h", "0 AS y", "0 AS fold", "'en' AS lang", "'a' AS text")
    found = toxicity.in_parts(rows, 11).selectExpr("part", "spark_partition_id() AS task").distinct().collect()
    assert len(found) == len({r.task for r in found}) == len({r.part for r in found}) == 11


def test_bitmap_keeps_all_labelled_rows_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("id AS __key", "'x' AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'y'"))
    kept = {r[0] for r in toxicity.likely(rows, spark.range(0, 20_000, 40).withColumnRenamed("id", "__id")).select("__key").collect()}
    assert set(range(0, 20_000, 40)) <= kept and len(kept) < 520
