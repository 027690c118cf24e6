"""Bounds that hold whatever repeats, scores by hand, pruning, and long inputs."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquill.llm import langid, quality, secret_scan, token_counts, topk
from sparkquill.llm.common import held, release, shared_dir, stored

SMALL = "/root/testdata/sf0.001"


def test_stored_tables_can_be_removed(spark):
    before = held(spark)
    rows = stored(spark.range(3), "removed-soon")
    assert rows.count() == 3 and len(held(spark)) == len(before) + 1
    release(spark, [p for p in held(spark) if p not in before])
    assert held(spark) == before and shared_dir(spark)


def test_language_sample_keeps_its_bound_where_ids_repeat(spark, monkeypatch):
    """One id with a thousand texts, and one text a thousand times, bring as many windows as the bound says."""
    monkeypatch.setattr(langid, "TEXTS_EACH", 20)
    seen = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, x, y: seen.append(len(x)) or self)
    rows = [(7, f"the text number {i} of many", "en") for i in range(1000)] + [(8, "one and the same", "fr")] * 1000
    langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8))
    assert seen == [20 + 1]


def test_quality_sample_keeps_its_bound_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)) or (np.zeros(x.shape[1]), 0.0))
    rows = [(7, f"the text number {i} of many") for i in range(1000)] + [(8, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    quality.train(docs, spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "doc_id bigint, quality int"))
    assert seen == [2]


def test_network_answers_as_a_plain_forward_pass(spark):
    """Log-probabilities of windows, and languages of texts, by loops over bytes and filters."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = langid.train(docs)

    def window(x):
        top = []
        for f in range(net.filters.shape[1]):
            best = max(
                sum(float(net.embed[x[p + j]][e]) * float(net.filters[j * langid.EMBED + e, f]) for j in range(langid.WIDEST) for e in range(langid.EMBED))
                for p in range(len(x) - langid.WIDEST + 1)
            )
            top.append(max(0.0, best + float(net.bias[f])))
        z = [sum(t * float(net.out[f, c]) for f, t in enumerate(top)) + float(net.base[c]) for c in range(len(net.classes))]
        low = max(z) + math.log(sum(math.exp(v - max(z)) for v in z))
        return [v - low for v in z]

    texts = [(1, "Les mots de la page sont ici."), (2, "The words of the page are here, " * 9), (3, "x")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id bigint, text string"), net).collect()}
    for i, t in texts:
        raw = t.encode()
        parts = [raw[a : a + langid.WINDOW] for a in range(0, len(raw), langid.WINDOW)]
        each = [(window(p.ljust(langid.WINDOW, b"\0")), len(p)) for p in parts]
        mean = [sum(z[c] * n for z, n in each) / len(raw) for c in range(len(net.classes))]
        p = [math.exp(v) / sum(math.exp(w) for w in mean) for v in mean]
        assert got[i].lang_pred == net.classes[p.index(max(p))] and abs(got[i].score - max(p)) < 1e-3


def test_posteriors_by_hand(spark, monkeypatch):
    """Host and path rates shrunk by moments, each document left out of its own group."""
    monkeypatch.setattr(quality, "train", lambda *a: (np.array([0.0, 1.0, *[0.0] * (quality.FEATURES - 2)]), -2.0))
    monkeypatch.setattr(quality, "HOT", 3)
    docs = [(i, "w " * (1 + i * 7 % 40), "abc"[i % 3] if i < 40 else None, "xy"[i % 2]) for i in range(60)] + [(60, None, "a", "x"), (1, "w", "a", None)]
    rows = quality.score_quality(spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string"), None).collect()
    sig = lambda z: 1 / (1 + math.exp(-z))
    odds = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    z = [math.log1p(len((t or "").split())) - 2.0 for _, t, _, _ in docs]
    p = [sig(v) for v in z]
    hosts, paths = {}, {}
    for v, (_, _, h, q) in zip(p, docs):
        for d, k in ((hosts, h), (paths, (h, q))):
            n, s = d.get(k, (0, 0.0))
            d[k] = (n + 1, s + v)
    rate = sum(p) / len(p)

    def weight(groups):  # of (n, k, rate)
        total = sum(n for n, _, _ in groups)
        between = sum(n * (k / n - r) ** 2 for n, k, r in groups) / total - sum(r * (1 - r) for _, _, r in groups) / total
        return min(max(sum(r * (1 - r) for _, _, r in groups) / len(groups) / max(between, 1e-9) - 1, quality.WEIGHTS[0]), quality.WEIGHTS[1])

    hw = weight([(n, k, rate) for n, k in hosts.values()])
    pw = weight([(n, k, (hosts[h][1] + hw * rate) / (hosts[h][0] + hw)) for (h, _), (n, k) in paths.items()])
    want = []
    for v, pv, (i, _, h, q) in zip(z, p, docs):
        host = (hosts[h][1] - pv + hw * rate) / (hosts[h][0] - 1 + hw)
        path = (paths[h, q][1] - pv + pw * host) / (paths[h, q][0] - 1 + pw)
        want.append((i, v, host, path, sig(v + odds(path) - odds(rate))))
    assert len(rows) == len(want)
    for a, b in zip(sorted(tuple(r)[:5] for r in rows), sorted(want)):
        assert a[0] == b[0] and all(abs(x - y) < 2e-6 for x, y in zip(a[1:], b[1:]))


def test_token_table_changes_no_count(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(map(tuple, token_counts.count_tokens(docs, path).collect()))
    monkeypatch.setattr(token_counts, "SAMPLED", 0)
    assert sorted(map(tuple, token_counts.count_tokens(docs, path).collect())) == want


@pytest.mark.parametrize("kind", ["spread", "clustered", "hot"])
def test_top_k_over_many_blocks(spark, monkeypatch, kind):
    """More rows than a leaf, a block and a cell hold, and ids that repeat with other vectors."""
    monkeypatch.setattr(topk, "BLOCK", 300)
    monkeypatch.setattr(topk, "ASKED", 60)
    monkeypatch.setattr(topk, "LEAF", {"row": 64, "query": 16})
    draw, n = np.random.default_rng(1), 1600
    x = draw.normal(0, 1, (n, 8))
    if kind == "clustered":
        x = draw.normal(0, 5, (10, 8))[draw.integers(0, 10, n)] + draw.normal(0, 0.05, (n, 8))
    if kind == "hot":
        x[: n // 3] = x[0]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    rows += [(20, rows[5][1]), (40, rows[40][1]), (60, [1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(6), F.col("vec_id") % 20 == 0, 20)
    grid = [(i, np.pad(np.floor(64 * np.array(v)), (0, 8 - len(v)))) for i, v in rows]
    asked, want = {}, set()
    for (i, v), (_, raw) in zip(grid, rows):
        if i % 20 == 0:
            asked[i] = min(asked.get(i, (tuple(np.floor(64 * np.array(raw))), tuple(v))), (tuple(np.floor(64 * np.array(raw))), tuple(v)))
    for i, (_, v) in asked.items():
        best = sorted((-int(np.array(v) @ w), j) for j, w in grid if j != i)[:20]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want


def test_clustered_leaf_pairs_are_pruned():
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 20, (40, 16))
    x = centres[draw.integers(0, 40, 8000)] + draw.normal(0, 0.1, (8000, 16))
    rows, asked = topk.Tree(np.arange(8000), x, 200), topk.Tree(np.arange(8000, 8400), x[:400], 50)
    seen = {}
    _, ids, scores = topk.search(asked, rows, 5, None, seen)
    leaves = [sum(not n[5] for n in t.nodes) for t in (rows, asked)]
    assert seen["scored"] < 0.5 * leaves[0] * leaves[1]
    for q in range(0, 400, 40):
        assert np.allclose(scores[q], np.sort(x @ asked.points[q])[::-1][:5])


def test_long_texts_with_many_secrets(spark):
    """Ten times the matches take about ten times as long, not a hundred times."""
    text = lambda n: "".join(f"é password = abcdefgh{i} ." for i in range(n))
    took = []
    for n in (500, 30_000):
        docs = spark.createDataFrame([(1, text(n)), (2, "clean")], "doc_id bigint, text string")
        began = time.time()
        assert secret_scan.find_secrets(docs).where("doc_id = 1").select(F.size("found")).first()[0] == n
        left = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
        assert left[1] == "é [REDACTED:assign] ." * n and left[2] == "clean"
        took.append(time.time() - began)
    assert took[1] < 15 + 5 * took[0]


def test_ledger_is_made_by_the_first_run_and_follows_the_rules(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "token: abcdefgh12"), (2, "token: abcdefgh12"), (3, "")], "doc_id bigint, text string")
    path = f"file://{tmp_path}/none-yet"
    for _ in range(2):
        assert [len(r.found) for r in secret_scan.find_secrets(docs, ledger_path=path).orderBy("doc_id").collect()] == [1, 1, 0]
        assert spark.read.parquet(path).count() == 2
    spark.read.parquet(path).write.parquet(f"file://{tmp_path}/twice")
    spark.read.parquet(path).write.mode("append").parquet(f"file://{tmp_path}/twice")
    assert [len(r.found) for r in secret_scan.find_secrets(docs, ledger_path=f"file://{tmp_path}/twice").orderBy("doc_id").collect()] == [1, 1, 0]
    monkeypatch.setattr(secret_scan, "RULE_VERSION", secret_scan.RULE_VERSION + 1)
    secret_scan.find_secrets(docs, ledger_path=path).count()
    assert spark.read.parquet(path).count() == 4
