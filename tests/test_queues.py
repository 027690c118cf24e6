"""Greedy batches against a plain fold, over blocks far smaller than a queue."""

import random

import pytest

from sparkquill.operators import queues


def folded(rows, most, room):
    out, queue, state = [], object(), None
    for g, o, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)):
        s = s or 0
        if g != queue:
            queue, state = g, (0, 0, 0)
            batch, n, chars = state
        elif n == most or chars + 1 + s > room:
            batch, n, chars = batch + 1, 0, 0
        chars += s + (n > 0)
        n += 1
        out.append((g, o, batch))
    return out


@pytest.mark.parametrize("block, part, most, room", [(7, 40, 3, 30), (5, 1000, 5, 10_000), (64, 90, 60, 200), (1, 33, 1, 5), (16, 50, 4, 0)])
def test_batches_against_a_fold(spark, monkeypatch, block, part, most, room):
    monkeypatch.setattr(queues, "BLOCK", block)
    monkeypatch.setattr(queues, "SORTED", part)
    draw = random.Random(block * most)
    rows = [(1, i, draw.choice([0, 3, 9, 40, None])) for i in range(500)] + [(None, i, draw.randint(0, 20)) for i in range(60)] + [(q, 1, draw.randint(0, 99)) for q in range(2, 40)]
    rows += [(1, 250, 9)] * 20  # ties
    df = spark.createDataFrame(rows, "queue int, o int, size int").repartition(6)
    got = sorted(((r.queue, r.o, r.batch) for r in queues.batches(df, "queue", "o", "size", most, room).collect()), key=repr)
    assert got == sorted(folded(rows, most, room), key=repr)


def test_empty_queue_and_wrong_bound(spark):
    df = spark.createDataFrame([], "queue int, o int, size int")
    assert queues.batches(df, "queue", "o", "size", 3, 10).collect() == []
    with pytest.raises(ValueError):
        queues.batches(df, "queue", "o", "size", 0, 10)
