"""Fill-in-the-middle cuts against plain Python, and the texts rebuilt from outputs alone."""

import hashlib
import random
import re

import pytest

from sparkquill.llm import fill_in_middle as fim
from test_corpus import CLASHES, SCHEMA, texts

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def by_hand(i, text):
    t = text or ""
    units = UNIT.findall(t)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    draw = random.Random(9)
    out = [(i, t) for i, t, _ in texts()]
    out += [(100 + k, "".join(draw.choice(["a", "é", "😀", " ", "\n", " ", "<", ">", "S", "<S", "P>", "\x0b", "\x00", "漢"]) for _ in range(draw.randint(0, 40)))) for k in range(300)]
    out += [(500, "a<P>b c"), (501, " \t "), (502, "<S> <M>"), (503, "x" * 200_000), (504, "w " * 100_000), (504, "w " * 100_000), (None, "x y z"), (505, " " * 100_000), (506, "ends with < and <S")]
    return out


def test_cuts_and_restored_texts(spark):
    rows = [(i, t, None, "s", 0, *CLASHES) for i, t in odd_texts()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = fim.restore(fim.fill_in_middle(docs)).collect()
    want = [by_hand(i, t) for i, t in odd_texts()]
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(((r.doc_id, r.restored) for r in got), key=repr) == sorted(((i, t or "") for i, t in odd_texts()), key=repr)


@pytest.mark.parametrize("rate, spm, form", [(100, 0, "psm"), (100, 100, "spm"), (0, 50, "plain")])
def test_rates_are_parameters(spark, rate, spm, form):
    docs = spark.createDataFrame([(k, f"one two three {k}") for k in range(50)], "key bigint, body string")
    out = fim.fill_in_middle(docs, "key", "body", rate=rate, spm_rate=spm)
    assert {r.form for r in out.collect()} == {form}
    assert {(r.key, r.restored) for r in fim.restore(out).collect()} == {(k, f"one two three {k}") for k in range(50)}


def test_empty_table(spark):
    assert fim.restore(fim.fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []
