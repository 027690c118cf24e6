"""Token counts of whole texts by a map-side two-tier lookup.

Texts are cut at spaces that no piece of the vocabulary crosses. Tier one is a broadcast table of TIER frequent units and
their lengths, taken from a sample of SAMPLED texts, which is read before: it changes the speed and never a count. Arrow looks units up in
it by hash. Tier two is a cache in each worker for units that the table lacks; the library encodes those that the cache
lacks too. For the counts texts are gone over once. Units are never shuffled: what the sample's tasks send on is a table of TIER units each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import table, text_chunks

#: Rows of the broadcast table, and texts (on average) of the sample that they are taken from.
TIER, SAMPLED = 16384, 8000
#: Units that a task of the sample counts at once, and that a worker's cache holds.
COUNTED, CACHED = 200_000, 300_000
#: Groups that the sample's tables are merged in.
MERGED = 16
LIMIT = 4096
_models: dict[str, "Model"] = {}


class Model:
    """A SentencePiece model, and lengths of units seen in this worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("a piece goes across a space or a line break: texts can't be cut there")
        #: whether ' .' and ' ,' after a letter always are a piece of their own
        self.marks = not any(re.search(r"[A-Za-zÀ-ÿ][.,]", p) for p in pieces) and {".", ","} <= set(pieces)
        self.lengths: dict[str, int] = {}

    def unit(self, unit: str) -> int:
        """Tokens of a unit after one space; of one that begins with a line break, without a space."""
        tail = 0
        if self.marks and len(unit) > 1 and unit[-1] in ".," and ("a" <= unit[-2] <= "z" or "à" <= unit[-2] <= "ÿ"):
            unit, tail = unit[:-1], 1
        known = self.lengths.get(unit)
        if known is None:
            if len(self.lengths) >= CACHED:
                self.lengths.clear()
            known = len(self.library.encode(unit)) - (unit[:1] == "\n")
            self.lengths[unit] = known
        return known + tail

    def whole(self, text: str) -> int:
        return len(self.library.encode(text))


def model(path: str) -> Model:
    """One for each worker process, kept between tasks."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def units(texts):
    """(list array of units for each text, mask of texts that can't be cut this way).

    The space that the library puts before a text and each line break are turned into a space and its unit, so
    that every unit stands after one space. Runs of spaces, and spaces at an end, make an empty unit: such texts
    are encoded whole.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.replace_substring(pc.fill_null(texts, ""), "▁", " ")
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    flat, offsets = lists.flatten(), np.asarray(lists.offsets)
    empty = np.concatenate([[0], np.cumsum(np.asarray(pc.equal(pc.binary_length(flat), 0)).astype(np.int64))])
    return flat, offsets - offsets[0], empty[offsets[1:] - offsets[0]] > empty[offsets[:-1] - offsets[0]]


def most_frequent(seen: dict[str, int], n: int) -> dict[str, int]:
    return dict(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:n])


def frequent_units(docs: DataFrame, text_col: str) -> list[str]:
    """The TIER most frequent units of a sample of SAMPLED texts; only these units come to the driver.

    Each task of the sample makes one row, its table; groups of tables, and then these, are merged to one.
    """
    row = "units array<string>, n array<bigint>"

    def one(seen: dict[str, int]):
        import pyarrow as pa

        top = most_frequent(seen, TIER)
        return pa.RecordBatch.from_arrays([pa.array([list(top)], pa.list_(pa.string())), pa.array([list(top.values())], pa.list_(pa.int64()))], ["units", "n"])

    def run(batches):
        import pyarrow.compute as pc

        seen: dict[str, int] = {}
        for part in text_chunks(batches):
            flat, _, _ = units(part.column(0))
            found = pc.value_counts(flat)
            found = found.filter(pc.greater(found.field(1), 1))  # a unit that is frequent is there more than once
            for unit, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
                if len(unit) <= 64:
                    seen[unit] = seen.get(unit, 0) + n
            if len(seen) > COUNTED:
                seen = most_frequent(seen, COUNTED // 2)
        if seen:
            yield one(seen)

    def merge(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            for names, counts in zip(batch.column(0), batch.column(1)):
                for unit, n in zip(names.as_py(), counts.as_py()):
                    seen[unit] = seen.get(unit, 0) + n
                if len(seen) > COUNTED:
                    seen = most_frequent(seen, COUNTED // 2)
        if seen:
            yield one(seen)

    share = min(1.0, SAMPLED / max(1, docs.count()))
    tables = docs.sample(share, seed=1).select(F.col(f"`{text_col}`")).mapInArrow(run, row)
    merged = tables.repartition(MERGED).mapInArrow(merge, row).coalesce(1).mapInArrow(merge, row).collect()
    return merged[0][0] if merged else []


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. The whole text is counted.

    Null text counts as empty, which has no tokens. Null ids and repeated rows keep their rows; an empty table gives
    none; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    top = frequent_units(docs, text_col)
    own = model(model_path)
    tier = docs.sparkSession.sparkContext.broadcast((top, [own.unit(u) for u in top]))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        use = model(model_path)
        names = pa.array(tier.value[0], pa.string())
        sizes = np.array([*tier.value[1], 0], dtype=np.int64)
        for part in text_chunks(batches):
            texts = part.column(1)
            flat, offsets, odd = units(texts)
            at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=names), -1))
            lengths = sizes[at]
            missed = np.flatnonzero(at < 0)
            if len(missed):
                few = pc.dictionary_encode(flat.take(pa.array(missed)))
                each = np.array([use.unit(u) if u else 0 for u in few.dictionary.to_pylist()], dtype=np.int64)
                lengths[missed] = each[np.asarray(few.indices)]
            sums = np.concatenate([[0], np.cumsum(lengths)])
            n = sums[offsets[1:]] - sums[offsets[:-1]]
            for i in np.flatnonzero(odd):
                n[i] = use.whole(texts[i].as_py() or "")
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
