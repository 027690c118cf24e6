"""Language ID by a byte convolutional network trained in numpy.

Bytes are embedded; filters of several widths slide over windows of WINDOW bytes; each filter's largest answer in
the window goes through a ReLU to a softmax. The network is fitted to a bounded sample of labelled texts and applied to
every window of every text; a text's languages are the mean of its windows' log-probabilities, by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkquill.llm.common import packed, table, text_chunks, unpacked

WINDOW, EMBED = 256, 8
#: Filters of each width in bytes.
FILTERS = {2: 8, 3: 12, 4: 12}
WIDEST = max(FILTERS)
#: The sample: labelled texts of each language, and windows of each of these.
TEXTS_EACH, WINDOWS_EACH = 500, 4
#: Groups of partitions that the sample is drawn in first.
MERGE_GROUPS = 64
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"
#: Windows answered at once.
AT_ONCE = 128


def windows(texts):
    """(bytes of all windows, text of each window, bytes of text in it); the last window of a text is padded with NULs."""
    import numpy as np

    sizes = np.array([len(t) for t in texts])
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    filled = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
    padded = b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist()))
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW), owner, filled


class Network:
    def __init__(self, classes: list[str], seed: int = 7):
        import numpy as np

        draw, f = np.random.default_rng(seed), sum(FILTERS.values())
        self.classes = classes
        #: filters narrower than WIDEST see zeros in place of their last bytes
        self.mask = np.concatenate(
            [np.repeat((np.arange(WIDEST) < w).astype(np.float32), EMBED)[:, None].repeat(k, 1) for w, k in FILTERS.items()], 1
        )
        self.embed = draw.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = draw.normal(0, 0.3, (WIDEST * EMBED, f)).astype(np.float32) * self.mask
        self.bias = np.zeros(f, np.float32)
        self.out = draw.normal(0, 0.3, (f, len(classes))).astype(np.float32)
        self.base = np.zeros(len(classes), np.float32)

    def seen(self, x):
        """The embedded bytes under the filters at each place: (windows, places, WIDEST * EMBED)."""
        import numpy as np

        e, places = self.embed[x], x.shape[1] - WIDEST + 1
        return np.concatenate([e[:, j : j + places] for j in range(WIDEST)], axis=2)

    def log_odds(self, x):
        """Log-probabilities of each class for each window."""
        import numpy as np

        answers = []
        for at in range(0, len(x), AT_ONCE):
            under = self.seen(x[at : at + AT_ONCE])
            answers.append((under.reshape(-1, under.shape[2]) @ self.filters).reshape(*under.shape[:2], -1).max(axis=1))
        top = np.maximum(np.concatenate(answers) + self.bias, 0)
        z = top @ self.out + self.base
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x, y) -> "Network":
        """Cross-entropy by Adam; the gradient goes through each filter's best place only."""
        import numpy as np

        names = ("embed", "filters", "bias", "out", "base")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        draw, step, f = np.random.default_rng(11), 0, self.filters.shape[1]
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                xb, yb = x[rows], y[rows]
                under = self.seen(xb)
                found = under @ self.filters
                place = found.argmax(axis=1)
                top = np.take_along_axis(found, place[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(top, 0)
                z = hidden @ self.out + self.base
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), yb] -= 1
                p /= len(rows)
                d = (p @ self.out.T) * (top > 0)
                best = under[np.arange(len(rows))[:, None], place]  # (rows, filters, WIDEST * EMBED)
                to_embed = np.zeros_like(self.embed)
                back = (d[:, :, None] * self.filters.T[None]).reshape(len(rows), f, WIDEST, EMBED)
                at_bytes = xb[np.arange(len(rows))[:, None, None], place[:, :, None] + np.arange(WIDEST)]
                np.add.at(to_embed, at_bytes.reshape(-1), back.reshape(-1, EMBED))
                grads = {
                    "embed": to_embed,
                    "filters": np.einsum("bfe,bf->ef", best, d) * self.mask,
                    "bias": d.sum(axis=0),
                    "out": hidden.T @ p,
                    "base": p.sum(axis=0),
                }
                step += 1
                for k in names:
                    first[k] += 0.1 * (grads[k] - first[k])
                    second[k] += 0.001 * (grads[k] ** 2 - second[k])
                    change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - RATE * change).astype(np.float32))
        return self


def held_out(id_col: str):
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fits a network to TEXTS_EACH texts of each language, WINDOWS_EACH windows of each; None without labelled texts.

    The texts are those with the least hashes of id and text, of rows that aren't held out; rows that repeat both count as one, so
    the bound holds whatever repeats. It grows with the number of languages alone: TEXTS_EACH * WINDOWS_EACH * WINDOW bytes of each
    (512 KB) come to the driver, and nothing else.
    """
    import numpy as np

    usable = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(id_col)).select(
        F.col(f"`{lang_col}`").alias("__lang"),
        F.xxhash64(F.col(f"`{id_col}`")).alias("__h"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("__t"),
        F.col(f"`{text_col}`").alias("__text"),
    )
    chosen = usable.select("__lang", "__h", "__t", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("__g"))
    for by in (["__lang", "__g"], ["__lang"]):  # of each group of partitions first, so that a common language isn't one task
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("__h", "__t"))
        chosen = chosen.withColumn("__rank", rank).where(F.col("__rank") <= TEXTS_EACH).drop("__rank")
    chosen = chosen.select("__lang", "__h", "__t").distinct()
    # keys of TEXTS_EACH texts of each language, 24 bytes and the language's name each: the same bound as that of the driver's sample
    texts = usable.join(F.broadcast(chosen), ["__lang", "__h", "__t"], "left_semi").groupBy("__lang", "__h", "__t").agg(F.first("__text").alias("__text"))
    texts = texts.select("__lang", "__text")

    def run(batches):
        import pyarrow as pa

        for part in text_chunks(batches):
            whole = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            x, owner, filled = windows(whole)
            langs, out, taken = part.column(0).to_pylist(), ([], []), {}
            for i in np.argsort(np.arange(len(x)) * 2654435761 % (1 << 32)):
                o = int(owner[i])
                if taken.get(o, 0) < WINDOWS_EACH and (filled[i] == WINDOW or len(whole[o]) < WINDOW):
                    taken[o] = taken.get(o, 0) + 1
                    out[0].append(langs[o])
                    out[1].append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["lang", "x"])

    rows = sorted((r[0], bytes(r[1])) for r in texts.mapInArrow(run, "lang string, x binary").collect())
    if not rows:
        return None
    classes = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    return Network(classes).fit(x, np.array([classes.index(r[0]) for r in rows]))


def answers(network: Network | None, texts) -> tuple:
    """(languages, scores) of an Arrow array of texts."""
    import numpy as np
    import pyarrow.compute as pc

    letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    langs, scores = np.full(len(letters), UNKNOWN, dtype=object), np.zeros(len(letters))
    rows = np.flatnonzero(letters) if network else []
    if len(rows):
        x, owner, filled = windows([texts[int(i)].as_py().encode("utf-8", "surrogatepass") for i in rows])
        weighed = network.log_odds(x) * filled[:, None]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        mean = np.add.reduceat(weighed, first, axis=0) / np.add.reduceat(filled, first)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        langs[rows] = np.array(network.classes, dtype=object)[p.argmax(axis=1)]
        scores[rows] = p.max(axis=1)
    return langs, scores


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), from the whole text alone.

    Texts that are null or have no letter are `und` with score 0, as is every text when there is no network. Null ids
    and repeated rows keep their rows; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for part in text_chunks(batches, 1 << 20):
            langs, scores = answers(network, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["__id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"__id {kind}, lang_pred string, score double").withColumnRenamed("__id", id_col)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(
    docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Rows of docs, with all columns, whose text's language is told with a score of `least` or more.

    Rejected: null texts, texts without a letter, texts that are like no language learned. A declared language
    decides nothing. Null ids, repeated rows and other columns, whatever their names, are passed on; an empty table gives none.
    """
    network = train(docs, id_col, text_col, lang_col)
    rows, nth = packed(docs), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        # the text is read inside the packed row, so that it crosses to the task once
        beside = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(nth)], ["doc", "text"]) for b in batches)
        for part in text_chunks(beside, 1 << 20):
            langs, scores = answers(network, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array((langs != UNKNOWN) & (scores >= least)))], ["__doc"])
        # a worker serves other stages too, which shouldn't find this one's buffers
        pa.default_memory_pool().release_unused()

    return unpacked(rows.mapInArrow(run, T.StructType([rows.schema[0]])))
