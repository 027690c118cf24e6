"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of those of its hashed parts: the word itself and its runs of SIZES letters, ends marked.
Filters of several widths slide over the words of the whole text; each filter's largest answer anywhere in it goes through a ReLU to a
logistic output. The language of a text is told from its words by hashed Bayes counts, learned beside, and the log-odds are moved by that language's threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.llm.common import held, release, stored, table, text_chunks

BITS, EMBED = 15, 12
#: Letters of the runs, and filters of each width in words.
SIZES = (4, 5, 6)
FILTERS = {1: 8, 2: 8, 3: 8}
WIDEST = max(FILTERS)
#: The sample that the networks begin with: labelled texts of either label, and of each the stretches of STRETCH words that it gives at most.
TEXTS_EACH, STRETCH, STRETCHES = 2000, 512, 8
EPOCHS, BATCH, RATE = 6, 16, 0.01
#: Errors under which a text teaches nothing more.
SETTLED = 0.03
#: Parts of the labelled texts, of which each is scored by a network fitted to the others, for the thresholds.
FOLDS = 3
#: Labelled texts that one copy of the networks learns from before copies are averaged, and the rate at which.
TOGETHER, LATER = 8000, 0.001
#: Numbers of a network or a language's counts that are summed at once, and steps of log-odds by which texts are counted.
CHUNK, STEP = 4096, 0.01
NAMES = ("embed", "filters", "bias", "out", "base")
#: Toxic texts of a language that weigh as much as the threshold of all languages, and texts from which on a language has its own.
PRIOR, LEAST = 20, 20
#: Buckets of the bitmap of labelled ids.
BUCKETS = 2048
#: Words answered at once, and texts of the sample whose words are numbered at once.
AT_ONCE, TOGETHER_READ = 1 << 16, 256


def words_of(texts):
    """(flat Arrow array of the words of all texts, lower-cased runs of letters and digits; offsets of each text's words)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}\p{M}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():  # a text without words gives one empty one
        flat, offsets = flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets]
    return flat, offsets


def parts(words: list[str]):
    """(buckets of the hashed parts, first part of each word, bucket of each word as a whole)."""
    import numpy as np

    sizes = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))

    def bucket(h, salt: int):
        h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))) >> np.uint32(32 - BITS)

    whole = codes * powers(int(sizes.max()))[left - 1]
    whole = bucket(np.add.reduceat(whole, ends - sizes, dtype=np.uint32), 1)
    found, owner = [whole], [np.arange(len(words))]
    rolled = codes.copy()
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[: len(codes) - n + 1] * np.uint32(16777619) + codes[n - 1 :]
        if n in SIZES:
            at = np.flatnonzero(left[: len(rolled)] >= n)
            found.append(bucket(rolled[at], n))
            owner.append(np.searchsorted(ends, at, side="right"))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(words))), whole.astype(np.int64)


def powers(n: int):
    import numpy as np

    out = np.full(n, 16777619, dtype=np.uint32)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint32)


def language_table(counts: dict):
    """(names, log-probabilities of each hashed word in each language); counts: language -> how often it has each bucket of whole words."""
    import numpy as np

    names = sorted(counts)
    table = np.full((1 << BITS, len(names)), 0.1)
    for i, g in enumerate(names):
        table[:, i] += counts[g]
    return names, np.log(table / table.sum(axis=0)).astype(np.float32) if names else table


class Network:
    def __init__(self, seed: int = 5):
        import numpy as np

        draw, f = np.random.default_rng(seed), sum(FILTERS.values())
        self.embed = draw.normal(0, 0.3, (1 << BITS, EMBED)).astype(np.float32)
        #: filters narrower than WIDEST see zeros in place of their last words
        self.mask = np.concatenate([np.repeat(np.arange(WIDEST) < w, k).reshape(WIDEST, k) for w, k in FILTERS.items()], 1).astype(np.float32)[:, None]
        self.filters = draw.normal(0, 0.3, (WIDEST, EMBED, f)).astype(np.float32) * self.mask
        self.bias = np.zeros(f, np.float32)
        self.out = np.abs(draw.normal(0, 0.3, f)).astype(np.float32)
        self.base = np.full(1, -1.0, np.float32)

    @classmethod
    def joined(cls, networks: "list[Network]") -> "Network":
        """One network whose log-odds are the mean of those given: embeddings side by side, and each one's filters over its own."""
        import numpy as np

        out = cls.__new__(cls)
        # filters in order of width, as `answers` expects them
        order = np.argsort(np.concatenate([n.mask[:, 0].sum(axis=0) for n in networks]), kind="stable")
        out.embed = np.concatenate([n.embed for n in networks], axis=1)
        f = networks[0].filters.shape[2]
        blocks = np.zeros((WIDEST, out.embed.shape[1], f * len(networks)), np.float32)
        for i, n in enumerate(networks):
            blocks[:, i * EMBED : (i + 1) * EMBED, i * f : (i + 1) * f] = n.filters
        out.filters = blocks[:, :, order]
        out.mask = np.concatenate([n.mask for n in networks], axis=2)[:, :, order]
        out.bias = np.concatenate([n.bias for n in networks])[order]
        out.out = np.concatenate([n.out for n in networks])[order] / len(networks)
        out.base = np.mean([n.base for n in networks], axis=0)
        return out

    def vectors(self, buckets, first):
        """Embeddings of words: the means of their parts'."""
        import numpy as np

        n = np.diff(np.append(first, len(buckets)))
        if len(first) < 2048:  # a text alone
            return np.add.reduceat(self.embed[buckets], first, axis=0) / n[:, None]
        out = np.empty((len(first), self.embed.shape[1]), np.float32)
        for k in np.unique(n):  # words of as many parts at once
            at = np.flatnonzero(n == k)
            for lo in range(0, len(at), AT_ONCE // 16):
                of = at[lo : lo + AT_ONCE // 16]
                out[of] = self.embed[buckets[first[of][:, None] + np.arange(k)]].sum(axis=1) / k
        return out

    def answers(self, words, offsets, buckets, first):
        """(largest answer of each filter in each text, the word where it starts); no words answer as one of zeros.

        `words` numbers the words of all texts one after the other; after a text's last word stand zeros.
        """
        import numpy as np

        under = self.vectors(buckets, first) if len(first) else np.zeros((0, self.embed.shape[1]), np.float32)
        # filters are in order of width: from the first that sees the j-th word on
        wide = [int((self.mask[j, 0] == 0).sum()) for j in range(WIDEST)]
        shown = [np.concatenate([under @ self.filters[j][:, wide[j] :], np.zeros((1, self.filters.shape[2] - wide[j]), np.float32)]) for j in range(WIDEST)]
        nothing, f = len(under), self.filters.shape[2]
        top, place = np.zeros((len(offsets) - 1, f), np.float32), np.full((len(offsets) - 1, f), -1, dtype=np.int64)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        for at in range(0, len(words), AT_ONCE):
            to = min(at + AT_ONCE, len(words))
            i = np.arange(at, to)
            found = shown[0][words[at:to]]
            for j in range(1, WIDEST):
                found[:, wide[j] :] += shown[j][np.where(i + j < ends[at:to], words[np.minimum(i + j, len(words) - 1)], nothing)]
            a, b = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, to, side="left")
            for t in range(a, b):  # each text of the stretch
                lo, hi = max(int(offsets[t]), at) - at, min(int(offsets[t + 1]), to) - at
                if lo >= hi:
                    continue
                best = found[lo:hi].argmax(axis=0)
                value = found[lo:hi][best, np.arange(f)]
                more = (place[t] < 0) | (value > top[t])
                top[t][more], place[t][more] = value[more], (best + lo + at)[more]
        return top, place

    def log_odds(self, top):
        import numpy as np

        return np.maximum(top + self.bias, 0) @ self.out + self.base[0]

    def fit(self, texts, y) -> "Network":
        """EPOCHS turns over `texts` of (buckets, first parts, word numbers, whole words' buckets); the rarer label weighs more."""
        import numpy as np

        learner, draw = Learner(self, float(y.mean()), RATE), np.random.default_rng(11)
        for _ in range(EPOCHS):
            order = draw.permutation(len(y))
            for at in range(0, len(y), BATCH):
                rows = order[at : at + BATCH]
                learner.learn([texts[r] for r in rows], y[rows])
        return self


class Learner:
    """Logistic loss by Adam; gradients go through each filter's best place only. `share` of the texts are toxic."""

    def __init__(self, net: Network, share: float, rate: float):
        import numpy as np

        self.net, self.rate, self.step = net, rate, 0
        self.mean = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
        self.square = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
        self.weight = {1: (0.5 / max(1e-9, share)) ** 0.5, 0: (0.5 / max(1e-9, 1 - share)) ** 0.5}

    def learn(self, texts, y) -> None:
        """One step, by a few texts, whose words are answered together."""
        import numpy as np

        net, grads = self.net, {k: np.zeros_like(v) for k, v in self.mean.items()}
        ends = np.cumsum([len(t[2]) for t in texts])
        before = [np.cumsum([0, *map(len, column)])[:-1] for column in ([t[0] for t in texts], [t[1] for t in texts])]
        buckets = np.concatenate([t[0] for t in texts])
        first, words = (np.concatenate([t[k] + n for t, n in zip(texts, before[k - 1])]) for k in (1, 2))
        top, place = net.answers(words, np.append(0, ends), buckets, first)
        hidden = np.maximum(top + net.bias, 0)
        error = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.base[0], -30, 30))) - y
        d = np.where(np.abs(error) < SETTLED, 0, np.where(y == 1, self.weight[1], self.weight[0]) * error / len(texts)).astype(np.float32)
        down = d[:, None] * net.out * (hidden > 0)
        grads["out"], grads["base"], grads["bias"] = d @ hidden, grads["base"] + d.sum(), down.sum(axis=0)
        inside = (place[:, :, None] + np.arange(WIDEST) < ends[:, None, None]) & (place >= 0)[:, :, None]
        t, k, j = np.nonzero((net.mask[:, 0] > 0).T & (down != 0)[:, :, None] & inside)
        if len(t):
            after, w = np.append(first, len(buckets)), words[place[t, k] + j]
            n = after[w + 1] - after[w]
            starts = np.cumsum(n) - n
            own = buckets[np.repeat(after[w] - starts, n) + np.arange(n.sum())]
            np.add.at(grads["filters"], (j, slice(None), k), down[t, k, None] * np.add.reduceat(net.embed[own], starts, axis=0) / n[:, None])
            shares = np.repeat((down[t, k] / n)[:, None] * net.filters[j, :, k], n, axis=0).astype(np.float32)
            np.add.at(grads["embed"].reshape(-1), (own[:, None] * EMBED + np.arange(EMBED)).ravel(), shares.ravel())
        self.step += 1
        for k, g in grads.items():
            mean, square = self.mean[k], self.square[k]
            mean *= 0.9
            square *= 0.999
            square += 0.001 * g * g
            g *= 0.1
            mean += g
            change = np.sqrt(square / (1 - 0.999**self.step))
            change += 1e-8
            np.divide(mean, change, out=change)
            change *= self.rate / (1 - 0.9**self.step)
            setattr(net, k, getattr(net, k) - change)


def numbered(texts):
    """(word numbers, offsets of the texts, buckets of the distinct words' parts, first part of each, buckets of whole words)."""
    import numpy as np

    flat, offsets = words_of(texts)
    known = flat.dictionary_encode()
    none = np.zeros(0, np.int64)
    return np.asarray(known.indices).astype(np.int64), offsets, *(parts(known.dictionary.to_pylist()) if len(flat) else (none, none, none))


def best_threshold(z, y, n=None) -> float:
    """Where log-odds part the labels with the best F1, halfway between two texts; the higher one in a tie. Each z stands for n texts (1), y of them toxic."""
    import numpy as np

    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.cumsum(np.ones(len(y)) if n is None else n[order]) + y.sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1  # equal log-odds aren't parted
    at = int(f1.argmax())
    after = z[order][at + 1] if at + 1 < len(z) else z[order][at] - 1.0
    return float((z[order][at] + after) / 2)


def alone(net: Network, text) -> float:
    import numpy as np

    buckets, first, words, _ = text
    return float(net.log_odds(net.answers(words, np.array([0, len(words)]), buckets, first)[0])[0])


class Model:
    """FOLDS networks, each fitted to all labelled texts but those of one fold, whose mean log-odds count; the languages' words and their thresholds.

    tallies: (language, log-odds, texts, toxic texts) of all labelled texts, each by the network that hasn't seen it.
    """

    def __init__(self, networks: list[Network], counts: dict, tallies: list[tuple]):
        import numpy as np

        self.names, self.table = language_table(counts)
        self.networks, self.network = networks, Network.joined(networks)

        def threshold(rows):
            z = np.array(sorted({r[1] for r in rows}))
            at = np.searchsorted(z, [r[1] for r in rows])
            sums = [np.bincount(at, [r[k] for r in rows], len(z)) for k in (3, 2)]
            return best_threshold(z, *sums)

        self.all = threshold(tallies)
        self.thresholds = np.full(len(self.names), self.all)
        for i, g in enumerate(self.names):
            own = [r for r in tallies if r[0] == g]
            n = sum(r[3] for r in own)
            if n:
                self.thresholds[i] = (n * threshold(own) + PRIOR * self.all) / (n + PRIOR)

    def scores(self, texts):
        """Scores of an Arrow array of texts, each by the whole text alone: one half stands for its language's threshold."""
        import numpy as np

        words, offsets, buckets, first, whole = numbered(texts)
        z = self.network.log_odds(self.network.answers(words, offsets, buckets, first)[0]).astype(float)
        limit = np.full(len(z), self.all)
        if self.names:
            own = self.table[whole]
            for t in np.flatnonzero(np.diff(offsets)):
                lo, hi = offsets[t], offsets[t + 1]
                sums = sum(own[words[a : min(a + AT_ONCE, hi)]].sum(axis=0, dtype=float) for a in range(lo, hi, AT_ONCE))
                limit[t] = self.thresholds[sums.argmax()]
        return np.round(1 / (1 + np.exp(-np.clip(z - limit, -30, 30))), 6)


def held_out(id_col: str):
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0


def judged(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(__id, __y, __h, __fold) of labelled ids that aren't held out: the label is what most of an id's rows say.

    Folds follow one another in order of __h, within groups of about TOGETHER ids that hashes make.
    """
    rows = labels.where(F.col(f"`{label_col}`").isNotNull() & ~held_out(id_col)).groupBy(F.col(f"`{id_col}`").alias("__id"))
    rows = rows.agg((F.avg(F.col(f"`{label_col}`")) >= 0.5).cast("int").alias("__y")).withColumn("__h", F.xxhash64("__id"))
    groups = max(1, -(-rows.count() // TOGETHER))
    nth = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("__h"), F.lit(groups))).orderBy("__h", "__id"))
    return rows.withColumn("__fold", (nth - 1) % FOLDS)


def likely(found: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `found` (__key, ...) whose id is one of `ids` (__id), and few others: those whose bit is set in a bitmap of the ids' hashes.

    The bitmap has BUCKETS buckets of 32,768 bits, 8 MB in all, and is broadcast: so texts without a label aren't shuffled.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(BUCKETS * 32768))
    bucket, bit = lambda p: F.floor(p / 32768).cast("bigint"), lambda p: F.pmod(p, F.lit(32768))
    bitmap = ids.select(place("__id").alias("p")).groupBy(bucket(F.col("p")).alias("__bucket")).agg(F.bitmap_construct_agg(bit(F.col("p"))).alias("__bits"))
    rows = found.withColumn("__bit", bit(place("__key"))).withColumn("__bucket", bucket(place("__key"))).join(F.broadcast(bitmap), "__bucket")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return rows.where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).drop("__bit", "__bucket", "__bits")


def taught(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> DataFrame:
    """(h, y, fold, lang, text), stored: every labelled document that isn't held out, whole; rows that repeat an id count as one, by the least of its texts."""
    found = docs.select(F.col(f"`{id_col}`").alias("__key"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    known, kinds = judged(labels, id_col, label_col), {rows.schema[id_col].dataType.simpleString() for rows in (docs, labels)}
    if len(kinds) == 1 and kinds <= {"tinyint", "smallint", "int", "bigint", "string"}:  # ids of other kinds may be equal with unlike hashes
        found = likely(found, known)
    rows = found.join(known, F.col("__key") == F.col("__id")).select("__id", F.col("__h").alias("h"), F.col("__y").alias("y"), F.col("__fold").alias("fold"), "lang", "text")
    # by the id as well, so that what the join has dealt isn't dealt again
    return stored(rows.groupBy("__id", "h", "y", "fold").agg(F.min(F.struct("text", "lang")).alias("r")).select("h", "y", "fold", "r.lang", "r.text"), "taught")


def sampled(rows: DataFrame) -> list[tuple]:
    """(label, language, words, fold) of TEXTS_EACH rows (h, y, fold, lang, text) of either label at most, in order of h.

    Of a text of more than STRETCHES * STRETCH words, that many come to the driver, in stretches spread evenly over it.
    """
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}  # two rows
    # twice as many as wanted by their hashes first, so that one task ranks few rows whatever the number of labels
    share = F.shiftrightunsigned("h", 1) / float(1 << 63)
    few = rows.where(share < F.when(F.col("y") == 1, 2 * TEXTS_EACH / max(1, n.get(1, 0))).otherwise(2 * TEXTS_EACH / max(1, n.get(0, 0))))
    few = few.select("h", "y").withColumn("__rank", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("__rank") <= TEXTS_EACH).drop("__rank")
    found = rows.join(F.broadcast(few), ["h", "y"], "left_semi").select("h", "y", "fold", "lang", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in text_chunks(batches):
            flat, offsets = words_of(part.column(4))
            kept = []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                n = -(-(hi - lo) // STRETCH)
                which = range(n) if n <= STRETCHES else np.linspace(0, n - 1, STRETCHES).round().astype(int).tolist()
                kept.append(" ".join(" ".join(flat[lo + i * STRETCH : min(lo + (i + 1) * STRETCH, hi)].to_pylist()) for i in which))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(kept, pa.string())], ["h", "y", "fold", "lang", "words"])

    found = found.mapInArrow(run, "h bigint, y int, fold int, lang string, words string").collect()
    return [(r.y, r.lang, r.words, r.fold) for r in sorted(found, key=lambda r: (r.h, r.y))]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> list[tuple]:
    """(label, language, words) of the sample that the networks begin with; none of it is held out."""
    return [r[:3] for r in sampled(taught(docs, labels, id_col, text_col, lang_col, label_col))]


def each_text(texts):
    """(buckets, first parts, word numbers, whole words' buckets) of each text of an Arrow array, whose words are numbered together."""
    import numpy as np

    numbers, offsets, buckets, first, whole = numbered(texts)
    after = np.append(first, len(buckets)).astype(np.int64)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        known, words = np.unique(numbers[lo:hi], return_inverse=True)
        n = after[known + 1] - after[known]
        starts = np.cumsum(n) - n
        yield buckets[np.repeat(after[known] - starts, n) + np.arange(n.sum())], starts, words, whole[known]


def begun_with(spark: SparkSession, few: list[tuple]) -> list[Network]:
    """The networks fitted to a sample (label, language, words, fold), each in a task of its own, without the texts of its fold."""
    sent = spark.sparkContext.broadcast(few)

    def run(batches):
        import pickle

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = [r for r in sent.value if r[3] != k]
                texts = [t for at in range(0, len(own), TOGETHER_READ) for t in each_text(pa.array([r[2] for r in own[at : at + TOGETHER_READ]]))]
                net = Network().fit(texts, np.array([float(r[0]) for r in own])) if own else Network()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(net)], pa.binary())], ["k", "net"])

    import pickle

    found = spark.range(0, FOLDS, 1, FOLDS).mapInArrow(run, "k bigint, net binary").collect()  # FOLDS networks
    return [pickle.loads(bytes(r["net"])) for r in sorted(found, key=lambda r: r["k"])]


def in_parts(rows: DataFrame, parts: int) -> DataFrame:
    """(part, h, y, fold, lang, text) in order of h, each part a task of its own: by hashes of parts some tasks would have several and others none."""
    dealt = rows.select(F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int").alias("part"), "h", "y", "fold", "lang", "text")
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "h")


def refined(rows: DataFrame, networks: list[Network], share: float, n: int, langs: list[str]) -> tuple[list[Network], dict]:
    """(networks, counts of each language's hashed words) after all n rows (h, y, fold, lang, text), in parts of about TOGETHER texts.

    In each part copies of the networks learn from its texts, each but from those of its own fold; their weighted mean is what remains. A part's texts
    come in order of h, so the same rows give the same networks however they are dealt. Sums are taken by chunks: no task holds all copies.
    """
    import numpy as np

    parts = max(1, -(-n // TOGETHER))
    sent = rows.sparkSession.sparkContext.broadcast(networks)
    dealt = in_parts(rows, parts)

    def run(batches):
        import copy

        import pyarrow as pa

        state = None

        def begin(part):
            own = [copy.deepcopy(net) for net in sent.value]
            learners = [Learner(net, share, LATER) for net in own]
            return part, own, learners, [[] for _ in own], [0] * len(own), {}

        def step(k):
            _, _, learners, waiting, learned, _ = state
            if waiting[k]:
                learners[k].learn([w[0] for w in waiting[k]], np.array([w[1] for w in waiting[k]], dtype=float))
                learned[k] += len(waiting[k])
                waiting[k].clear()

        def end():
            for k in range(len(state[1])):
                step(k)
            part, own, _, _, learned, words = state
            flat = [(k, learned[k], np.concatenate([getattr(net, name).ravel() for name in NAMES])) for k, net in enumerate(own)]
            flat += [(len(own) + langs.index(g), 1, c) for g, c in sorted(words.items())]
            for slot, weight, values in flat:
                chunks = [values[at : at + CHUNK].astype(np.float64).tobytes() for at in range(0, len(values), CHUNK)]
                m = len(chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([part] * m, pa.int32()), pa.array([weight] * m, pa.int64()), pa.array(chunks, pa.binary())],
                    ["slot", "at", "part", "n", "x"],
                )

        for batch in text_chunks(batches):
            for part, y, fold, lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), each_text(batch.column(5))):
                if state is None or state[0] != part:
                    if state is not None:
                        yield from end()
                    state = begin(part)
                if lang in langs:
                    np.add.at(state[5].setdefault(lang, np.zeros(1 << BITS)), text[3][text[2]], 1)
                for k in range(FOLDS):
                    if fold != k:
                        state[3][k].append((text, y))
                        if len(state[3][k]) == BATCH:
                            step(k)
        if state is not None:
            yield from end()

    def summed(key, batches):
        import pyarrow as pa

        total, weight = 0.0, 0
        found = batches.sort_by("part")
        for n, x in zip(found["n"].to_pylist(), found["x"].to_pylist()):
            total, weight = total + n * np.frombuffer(x), weight + n
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([weight], pa.int64()), "x": pa.array([total.tobytes()], pa.binary())})

    copies = dealt.mapInArrow(run, "slot int, at int, part int, n bigint, x binary")
    # as many numbers as the networks and the languages' counts have
    found = sorted(copies.groupBy("slot", "at").applyInArrow(summed, "slot int, at int, n bigint, x binary").collect(), key=lambda r: (r["slot"], r["at"]))
    counts = {}
    for slot in sorted({r["slot"] for r in found}):
        own = [r for r in found if r["slot"] == slot]
        values, weight = np.concatenate([np.frombuffer(bytes(r["x"])) for r in own]), own[0]["n"]
        if slot >= FOLDS:
            counts[langs[slot - FOLDS]] = values
        elif weight:
            at = 0
            for name in NAMES:
                shape = getattr(networks[slot], name).shape
                size = int(np.prod(shape))
                setattr(networks[slot], name, (values[at : at + size] / weight).reshape(shape).astype(np.float32))
                at += size
    return networks, counts


def tallied(rows: DataFrame, networks: list[Network]) -> list[tuple]:
    """(language, log-odds in steps of STEP, texts, toxic texts) of all rows (y, fold, lang, text), each by the network that hasn't seen it."""
    sent = rows.sparkSession.sparkContext.broadcast(networks)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in text_chunks(batches, 1 << 20):
            fold, z = np.asarray(part.column(1)), np.zeros(part.num_rows)
            for k in range(FOLDS):
                at = np.flatnonzero(fold == k)
                if len(at):
                    words, offsets, buckets, first, _ = numbered(part.column(3).take(pa.array(at)))
                    z[at] = sent.value[k].log_odds(sent.value[k].answers(words, offsets, buckets, first)[0])
            steps = np.round(np.clip(z, -30, 30) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(steps)], ["y", "lang", "step"])

    found = rows.select("y", "fold", "lang", "text").mapInArrow(run, "y int, lang string, step bigint")
    # at most 60 / STEP rows of each language
    return [(r[0], r[1] * STEP, r[2], r[3]) for r in found.groupBy("lang", "step").agg(F.count("*"), F.sum("y")).collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic"):
    """A Model of all labelled texts that aren't held out; where these lack one of the labels, the share of toxic ones (0 without any).

    The networks begin with a sample, by several turns in a task for each; then the tasks go over every labelled text, whole, and the means of what
    they learn are the networks. Words of languages and thresholds are counted over every labelled text too.
    """
    before = held(docs.sparkSession)
    rows = taught(docs, labels, id_col, text_col, lang_col, label_col)
    try:
        n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if not 0 < toxic < n:
            return toxic / n if n else 0.0
        few = sampled(rows)
        begun = begun_with(docs.sparkSession, few)
        # as many rows as languages
        langs = sorted(r[0] for r in rows.where("lang is not null").groupBy("lang").count().where(F.col("count") >= LEAST).collect())
        networks, counts = refined(rows, begun, toxic / n, n, langs)
        return Model(networks, counts, tallied(rows, networks))
    finally:
        release(docs.sparkSession, [p for p in held(docs.sparkSession) if p not in before])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic"
) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted, from the whole text alone.

    Null texts count as empty; texts without words have the score of zeros under all filters, against the threshold of all languages.
    Null ids aren't held out. Null ids and repeated rows keep their rows; an empty table gives none; other columns aren't read. Without
    labels of both kinds nothing can be learned, and all texts have the share of toxic ones as their score.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, lang_col, label_col))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in text_chunks(batches, 1 << 20):
            use = model.value
            scores = np.full(part.num_rows, use) if isinstance(use, float) else use.scores(part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["__id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(held_out(id_col), F.lit(False)), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"__id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("__id", id_col)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
