"""Packs token ids into fixed windows by minimum bin slack.

Documents are tokenised once. Full windows are cut off; what remains of each document is shorter than a window. The
multiset of remaining lengths has fewer than CAPACITY distinct values, so its counts are a small table whatever
the corpus: the bins are planned on these counts. For each bin a bitset subset-sum program, seeded with the
longest length left, finds the multiset of lengths that leaves least slack; its counts are backtracked, and the bin is
repeated as often as the counts allow. Spark then ranks the remainders of each length, over salted groups,
and a join with the plan's rank intervals gives each piece its sequence and offset.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.llm.common import stored, table, text_chunks

CAPACITY = 1024
END = 0
#: Parts that the remainders of one length are ranked in.
SALTS = 256
#: Units that a worker's cache holds.
CACHED = 300_000
_tokenizers: dict[str, "Ids"] = {}


class Ids:
    """A byte-level BPE vocabulary, with the ids of units seen in this worker in flat arrays."""

    def __init__(self, ranks: str, pattern: str, special: tuple[tuple[str, int], ...]):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens=dict(special))
        self.clear()

    def clear(self) -> None:
        import numpy as np

        #: unit -> its number; number 0 is the end of a document
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.array([END], dtype="<u4"), np.array([0]), np.array([1])

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, allowed_special="all")

    def numbers(self, units: list[str]):
        """The number of each unit; -1 for those that have white space at an end, which can't stand alone."""
        import numpy as np

        fresh, out = [], []
        for unit in units:
            n = self.known.get(unit)
            if n is None:
                body = unit[1:]
                if body[:1].isspace() or body[-1:].isspace() or "\x00" in body or not body and unit[0] == " ":
                    n = -1
                else:
                    n = len(self.sizes) + len(fresh)
                    fresh.append(self.whole(body if unit[0] == "\x00" else unit))
                self.known[unit] = n
            out.append(n)
        if fresh:
            sizes = np.array([len(x) for x in fresh])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.array([y for x in fresh for y in x], dtype="<u4")])
        return np.array(out, dtype=np.int64)

    def encode(self, texts) -> tuple:
        """(ids of all texts, each with END at its end; where each begins and ends).

        Texts are cut before each space. A space between two characters that aren't white space begins a pre-token,
        so units can be encoded alone; texts with other spaces are encoded whole.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > CACHED:
            self.clear()
        texts = pc.fill_null(texts, "")
        # each unit keeps its space in front; the first one of a text gets a NUL in its place
        marked = pc.binary_join_element_wise(pa.scalar("\x00"), texts, "")
        lists = pc.split_pattern(pc.replace_substring(marked, " ", "\x01 "), "\x01")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        few = pc.dictionary_encode(lists.flatten())
        numbers = self.numbers(few.dictionary.to_pylist())[np.asarray(few.indices)]
        offsets -= offsets[0]
        bad = np.concatenate([[0], np.cumsum(numbers < 0)])
        odd = bad[offsets[1:]] > bad[offsets[:-1]]
        odd |= np.asarray(pc.match_substring(texts, "\x01")) | np.asarray(pc.match_substring(texts, "\x00"))
        numbers = np.insert(np.where(numbers < 0, 0, numbers), offsets[1:], 0)
        offsets = offsets + np.arange(len(offsets))
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[offsets]
        if odd.any():
            parts = [
                np.array([*self.whole(texts[i].as_py()), END], dtype="<u4") if odd[i] else ids[bounds[i] : bounds[i + 1]]
                for i in range(len(odd))
            ]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids.astype("<u4"), bounds


def tokenizer(ranks: str, pattern: str, special: tuple[tuple[str, int], ...]) -> Ids:
    """One for each worker process, kept between tasks."""
    if ranks not in _tokenizers:
        _tokenizers[ranks] = Ids(ranks, pattern, special)
    return _tokenizers[ranks]


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Added tokens of a tokenizers .json, which the library takes whole wherever a text has them."""
    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def cut_pieces(docs: DataFrame, ranks: str, pattern: str, special, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, perhaps ids): full windows of each document, and what remains."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        use = tokenizer(ranks, pattern, special)
        for part in text_chunks(batches):
            ids, bounds = use.encode(part.column(1))
            raw = memoryview(ids.tobytes())
            totals = np.diff(bounds)
            pieces = -(-totals // CAPACITY)
            row = np.repeat(np.arange(len(totals)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * CAPACITY
            length = np.minimum(totals[row] - start, CAPACITY)
            at = 4 * (bounds[row] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            columns = [part.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, totals[row]))]
            if with_ids:
                ends = np.concatenate([bounds[row] + start, bounds[-1:]]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    names = ["__id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    return rows.mapInArrow(run, f"__id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids)


def fullest(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The multiset with `seed` in it that leaves least slack: length -> how many. Longer lengths are tried first."""
    room, reach = capacity - seed, 1
    mask, layers = (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == seed), room // length)
        if left <= 0:
            continue
        layers.append((length, left, reach))
        step = 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {seed: 1}
    for length, most, before in reversed(layers):
        n = next(n for n in range(most + 1) if n * length <= at and before >> (at - n * length) & 1)
        if n:
            chosen[length] = chosen.get(length, 0) + n
            at -= n * length
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """(rows (length, lo, hi, each, base, offset), number of bins): which ranks of each length go to which bins.

    Of a length's items, those with rank lo to hi - 1 fill bins from base on, `each` to a bin, from offset on.
    Every round uses up a length or more, so there are at most `capacity` rounds however large the counts are.
    """
    left, used, plan, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        chosen = fullest(left, max(left), capacity)
        times = min(left[x] // n for x, n in chosen.items())
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            plan.append((length, used[length], used[length] + times * n, n, bins, offset))
            offset += n * length
            used[length] += times * n
            left[length] -= times * n
            if not left[length]:
                del left[length]
        bins += times
    return plan, bins


def pack(
    docs: DataFrame, ranks: str, pattern: str, special: tuple[tuple[str, int], ...], id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the piece's ids.

    Null and empty texts are the end id alone. Null ids and repeated rows are packed like any other; an empty
    table gives no rows; other columns are not read.
    """
    pieces = stored(cut_pieces(docs, ranks, pattern, special, id_col, text_col, with_ids), "pieces")
    rest = pieces.where(F.col("length") < CAPACITY).withColumn(
        "salt", F.pmod(F.xxhash64("__id", "doc_tokens", "ids_crc32"), F.lit(SALTS)).cast("int")
    )
    groups = stored(rest.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("n")).collect()}  # under CAPACITY rows
    plan, bins = plan_bins(counts)
    spans = docs.sparkSession.createDataFrame(plan, "p_length bigint, lo bigint, hi bigint, each bigint, base bigint, first bigint")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("__id", "start", "ids_crc32")
    ranked = (
        rest.withColumn("nth", F.row_number().over(order) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("nth") + F.col("before"))
    )
    within = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(spans), within).select(
        *pieces.columns,
        (F.col("base") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("first") + (nth % F.col("each")) * F.col("length")).alias("offset"),
    )
    full = pieces.where(F.col("length") == CAPACITY).select(
        *pieces.columns, (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return placed.unionByName(full).withColumnRenamed("__id", id_col)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are those of byte_bpe_50k.json: its ranks come from the .tiktoken file of the same vocabulary, its special tokens from the .json itself."""
    import public_tokenizers as p

    special = special_tokens(p.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, special)
