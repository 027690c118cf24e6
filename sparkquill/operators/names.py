"""A similarity join of names: all pairs of different names whose ratio of matching blocks reaches a threshold.

Names are compared in their plain forms; rows of one form are one class. With a ratio of T or more, the matched letters M of two names of |x| and |y| letters are
at least T (|x| + |y|) / 2, and they stand in at most |x| + |y| - 2M + 1 blocks, since between two blocks a letter is unmatched. So the names share
at least M - (q - 1) (blocks) runs of q letters, counted as often as they stand, and no more letters than |x| + |y| - 2M are without a partner. An index of runs
parts names of a few words badly, so all pairs are held against the bound on letters, by their bits, in blocks.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions import alignment as A
from sparkquill.sources.settings import settings
from sparkquill.sources.tables import read, stored

QUERIES, SQL = {}, {}
#: Names of a block, and words of 64 bits that hold a name's letters.
HELD, WORDS = 16384, 2
#: Letters up to which names are held as numbers, one bit for each; pairs with a longer one are compared by numbers of any length.
SHORT = 64
#: Pairs, and places of a table of letters, that are compared at once.
TOGETHER, PLACES = 1 << 15, 1 << 22


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def matched(x: int, y: int, least: float) -> int:
    """Letters at least that have to match in names of these lengths."""
    return math.ceil(least * (x + y) / 2 - 1e-9)


def lengths(x: int, least: float) -> list[int]:
    """Lengths of names that can have the ratio with one of x letters: no more can match than the shorter one has."""
    return [y for y in range(1, 2 * int(x / least) + 3) if matched(x, y, least) <= min(x, y)]


def shared(x: int, y: int, least: float, q: int) -> int:
    """Runs of q letters at least that two such names share."""
    m = matched(x, y, least)
    return m - (q - 1) * (x + y - 2 * m + 1)


def numbered(name: str, q: int) -> list[str]:
    """The runs of q letters of a name, with a number for those that repeat, and how long they are."""
    seen: Counter = Counter()
    out = []
    for i in range(len(name) - q + 1):
        g = name[i : i + q]
        seen[g] += 1
        out.append(f"{q}{g}{seen[g]}")
    return out


def spread(letter, nth):
    """The bit, of those of WORDS words, that stands for the nth occurrence of a letter; numbers or arrays of them."""
    mixed = (letter * 0x9E3779B97F4A7C15 + nth * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    return (((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF) >> (59 - WORDS.bit_length())


def counted(names: list[str]):
    """(lengths, counts of letters as bits of WORDS words, letters): a letter's nth occurrence is a bit by a hash, so that the bits two names differ in are no more than the letters.

    Bits have a row for each word, letters one for each place: code points plus one, 0 where a name has ended. Names of over SHORT letters have no letters there.
    """
    import numpy as np

    short = [x if len(x) <= SHORT else "" for x in names]
    sizes, width = np.array([len(x) for x in short], dtype=np.int64), max(map(len, short), default=0) or 1
    at = np.array(short, dtype=f"U{width}").view(np.uint32).reshape(len(short), width).T.astype(np.uint64)
    at = np.where(np.arange(width)[:, None] < sizes, at + np.uint64(1), np.uint64(0))
    bits = np.zeros((WORDS, len(names)), dtype=np.uint64)
    for k in range(width):
        h = spread(at[k], (at[:k] == at[k]).sum(axis=0, dtype=np.uint64))
        bit = np.where(at[k] > 0, np.uint64(1) << (h & np.uint64(63)), np.uint64(0))
        for w in range(WORDS):
            bits[w] ^= np.where(h >> np.uint64(6) == w, bit, np.uint64(0))
    for i, name in enumerate(names):
        if len(name) > SHORT:
            for c, n in Counter(name).items():
                for h in (spread(ord(c) + 1, k) for k in range(n)):
                    bits[h >> 6, i] ^= np.uint64(1) << np.uint64(h & 63)
    return np.array([len(x) for x in names], dtype=np.int64), bits, at


def common_letters(x: list[str], y: list[str]) -> list[int]:
    """The longest common subsequence of each pair, by bits of a number."""
    out = []
    for a, b in zip(x, y):
        at: dict[str, int] = {}
        for i, c in enumerate(a):
            at[c] = at.get(c, 0) | 1 << i
        full = (1 << len(a)) - 1
        v = full
        for c in b:
            u = v & at.get(c, 0)
            v = ((v + u) | (v - u)) & full
        out.append(len(a) - v.bit_count())
    return out


def common_of(rows, other, letters, table):
    """Letters of the table's rows that are in no longest common subsequence with the other names, as bits; `common_letters` for many names of SHORT letters at most.

    The table has the places of each letter of a name as bits, `letters` those of the other names, a row for each place.
    """
    import numpy as np

    flat, base = table.ravel(), rows * table.shape[1]
    v = np.full(len(rows), ~table.dtype.type(0))
    for row in letters:
        u = flat[base + row[other]]
        u &= v
        rest = v - u
        v += u
        v |= rest
    return v


def pairs_of(left: list[str], right: list[str], least: float, same: bool) -> list[tuple[str, str, float]]:
    """(a, b, ratio), a before b, of two blocks of names (of one, if `same`): all pairs of a ratio of `least` or more."""
    return [p for found in pairs_by_turns(left, right, least, same) for p in found]


def pairs_by_turns(left: list[str], right: list[str], least: float, same: bool) -> Iterator[list[tuple[str, str, float]]]:
    """What `pairs_of` gives, as lists, so that no more pairs are held at once than are compared at once.

    What doesn't match in two names is at least the letters that one has more often than the other, then what their longest common
    subsequence lacks; both bounds hold for any matching blocks, and only pairs that meet both are matched.
    """
    import numpy as np

    if same:
        left = right = sorted(left)
    (n, x, p), (m, y, q) = counted(left), counted(right)
    if not left or not right:
        return
    # letters by number, 0 where a name has ended
    used = np.zeros(0x110001, dtype=bool)
    used[0] = used[p] = used[q] = True
    size = int(used.sum())
    numbers = (np.cumsum(used) - 1).astype(np.uint8 if size <= 256 else np.int32)
    p, q = numbers[p], numbers[q]
    word = np.uint32 if len(p) <= 32 else np.uint64
    short_n, short_m = n <= SHORT, m <= SHORT
    bounds: dict[int, tuple] = {}

    def bounds_of(length: int):
        """For a left name's length: the letters that have to match, and one more than the bits that may differ (0 where the lengths alone are too far apart)."""
        if length not in bounds:
            need = np.ceil(least * (length + m) / 2 - 1e-9).astype(np.int64)
            room = np.where(need <= np.minimum(length, m), length + m - 2 * need + 1, 0)
            bounds[length] = need, np.clip(room, 0, 255).astype(np.uint8)
        return bounds[length]

    def compared(i: int, near: list) -> list[tuple[str, str, float]]:
        """Of the left names from the ith on, and those that `near` has for each, the pairs of the ratio."""
        out = []
        rows, other = np.repeat(np.arange(len(near)), [len(j) for j in near]), np.concatenate(near)
        need = np.concatenate([bounds_of(int(n[i + k]))[0][j] for k, j in enumerate(near)])
        table, each = np.zeros((len(near), size), dtype=word), np.arange(len(near))
        for k in range(len(p)):
            table[each, p[k, i : i + len(near)]] |= word(1 << k)
        table[:, 0] = 0
        whole = np.array([(1 << min(int(k), SHORT)) - 1 for k in n[i : i + len(near)]], dtype=np.uint64).astype(word)
        for at in range(0, len(rows), TOGETHER):
            r, o, least_of = (a[at : at + TOGETHER] for a in (rows, other, need))
            lacking = np.bitwise_count(common_of(r, o, q, table) & whole[r])
            met = n[i + r] - lacking >= least_of
            if long:
                short = short_n[i + r] & short_m[o]
                met &= short
                slow = np.flatnonzero(~short)
                met[slow] = np.array(common_letters([left[i + k] for k in r[slow]], [right[k] for k in o[slow]]), dtype=np.int64) >= least_of[slow]
            for name, also in zip((left[i + k] for k in r[met]), (right[k] for k in o[met])):
                if name != also:
                    a, b = min(name, also), max(name, also)
                    ratio = difflib.SequenceMatcher(None, a, b).ratio()
                    if ratio >= least:
                        out.append((a, b, ratio))
        return out

    near, held, most, long = [], 0, max(1, PLACES // size), not (short_n.all() and short_m.all())
    for i in range(len(left)):
        begin = i + 1 if same else 0
        apart = np.bitwise_count(y[0, begin:] ^ x[0, i])
        for w in range(1, WORDS):
            apart += np.bitwise_count(y[w, begin:] ^ x[w, i])
        near.append(np.flatnonzero(apart < bounds_of(int(n[i]))[1][begin:]) + begin)
        held += len(near[-1])
        if held >= TOGETHER or len(near) >= most:
            yield compared(i + 1 - len(near), near)
            near, held = [], 0
    if near:
        yield compared(len(left) - len(near), near)


def classes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(form, class_id, n): the plain forms of names, the least key of each and its rows. Null names, and names without a letter or digit, have none."""
    @F.pandas_udf("string")
    def form(x):
        return x.map(lambda v: None if v is None else A.name_form(v) or None)

    named = rows.select(F.col(key).alias("key"), form(F.col(name)).alias("form")).where("form is not null")
    return named.groupBy("form").agg(F.min("key").alias("class_id"), F.count("*").alias("n"))


def similar(rows: DataFrame, key: str, name: str, least: float | None = None) -> DataFrame:
    """(a, b, ratio), a before b: all pairs of classes of names of a ratio of `least` or more; a and b are forms.

    The ratio is that of the first form against the second, as the matcher isn't the same both ways. All blocks of names meet in pairs, each in a task of
    its own, so that a task holds two blocks; the work grows with the square of the names.
    """
    import pyarrow as pa

    least = settings().name_similarity if least is None else least
    if not 0.67 <= least <= 1:
        raise ValueError("the bounds hold for ratios from 0.67 on")
    forms = stored(classes(rows, key, name).select("form"), "name-forms")
    m = max(1, -(-forms.count() // HELD))
    # a pair of blocks i <= j meets once; pairs within a block are taken where a < b
    block = F.pmod(F.xxhash64("form"), F.lit(m)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = forms.select("form", block.alias("own"), each.alias("other"))
    met = dealt.select("form", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))

    def run(batches):
        sides, same = ([], []), False
        for part in batches:
            same = same or part.num_rows > 0 and part["i"][0].as_py() == part["j"][0].as_py()
            for name, second in zip(part["form"].to_pylist(), part["second"].to_pylist()):
                sides[second].append(name)
        for found in pairs_by_turns(sides[0], sides[0] if same else sides[1], least, same):
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))], ["a", "b", "ratio"])

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return met.repartition(min(m * (m + 1), 4096), "i", "j").groupBy("i", "j").applyInArrow(run, "a string, b string, ratio double")


def titled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a name: their first words up to 24 letters."""
    return read(spark, d, "documents").select("doc_id", F.regexp_substr("text", F.lit(r"^\S.{0,23}")).alias("name"))


@query()
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different names of documents that are near enough to be one, by the acceptance threshold of names."""
    return similar(titled(spark, d), "doc_id", "name")


@query()
def name_links(spark: SparkSession, d: str) -> DataFrame:
    """One row for each class of names: its least document, its size, and the number and best ratio of the classes that are near."""
    rows = titled(spark, d)
    pairs = stored(similar(rows, "doc_id", "name"), "name-pairs")
    ends = pairs.select(F.col("a").alias("form"), "ratio").union(pairs.select("b", "ratio")).groupBy("form").agg(F.count("*").alias("links"), F.max("ratio").alias("best"))
    out = classes(rows, "doc_id", "name").join(ends, "form", "left")
    return out.select("class_id", "form", "n", F.coalesce("links", F.lit(0)).alias("links"), "best")
