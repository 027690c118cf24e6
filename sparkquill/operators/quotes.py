"""Quotes held against the paragraphs of their sources by an index of word runs with their positions.

Each part of a quote, between its ellipses, has a few anchors: runs of literal words of which every stretch that reaches ALTERED holds one
as it is. Anchors and the paragraphs' word runs meet by an equi-join on hashes; each hit gives a window in which the part may stand, and only windows
are aligned. Parts that consist of bracketed words have no anchors; such quotes are counted, sent to the tasks in blocks and held against all paragraphs.
"""

from __future__ import annotations

from collections import Counter, OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions import alignment as A
from sparkquill.operators.documents import paragraphs
from sparkquill.operators.verdicts import pinpoint_page, quote_ladder, quote_notes, semantic_status
from sparkquill.sources.tables import read, stored

QUERIES, SQL = {}, {}
#: Anchors that are sent to the tasks to thin out word runs before they are joined; with more of them all runs are joined.
SENT = 2_000_000
#: Quotes without anchors that go over all paragraphs at once.
LOOSE = 256
#: Paragraphs whose words a task keeps, and quotes of which it keeps where they stand as they are.
KEPT, SURE = 64, 200_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def mixed(hashes, seeds, size: int):
    """A hash of each run of `size` words from the words' hashes; `seeds` has one number for each run."""
    import numpy as np

    out = seeds
    for j in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - size + 1 + j]
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def seed(size: int, scope: str | None) -> int:
    """Runs of different sizes and scopes have different hashes."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{size} {scope or ''}")


def word_hashes(words: list[str], known: dict[str, int]):
    import numpy as np
    import xxhash

    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.array([known[w] for w in words], dtype=np.uint64)


def run_hashes(words: list[str], size: int, scope: str | None):
    """A hash of each run of `size` words, which differs from scope to scope."""
    import numpy as np

    if len(words) < size:
        return np.zeros(0, np.int64)
    return mixed(word_hashes(words, {}), np.full(len(words) - size + 1, seed(size, scope), dtype=np.uint64), size)


PARSED = "tag bigint, words int, used boolean, loose boolean, anchors array<struct<anchor:bigint,part:int,before:int,after:int>>"


def parsed(quotes: DataFrame) -> DataFrame:
    """PARSED rows of quotes (tag, scope, quote): a window goes from `before` words before an anchor's place to `after` words behind it."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for tag, scope, quote in zip(pdf["tag"], pdf["scope"], pdf["quote"]):
                parts, used = A.segments(quote or "")
                found = [A.anchors(p) for p in parts]
                rows = []
                for n, (part, runs) in enumerate(zip(parts, found)):
                    words, edits = [w for w, _ in part], A.most_edits(len(part))
                    for first, size in runs or ():
                        h = int(run_hashes(words[first : first + size], size, scope)[0])
                        rows.append({"anchor": h, "part": n, "before": first + edits, "after": len(part) - first + edits})
                out.append((tag, sum(map(len, parts)), used, any(r is None for r in found), rows))
            yield pd.DataFrame(out, columns=["tag", "words", "used", "loose", "anchors"])

    return quotes.select("tag", "scope", "quote").mapInPandas(run, PARSED)


def postings(rows: DataFrame, known, sizes=range(1, A.ANCHOR + 1)) -> DataFrame:
    """(doc, para_no, anchor, at): places of the word runs of paragraphs (doc, para_no, scope, text), of those in `known` if it is given."""
    import numpy as np

    kind = rows.schema["doc"].dataType.simpleString()
    sent = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        seen: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # the words of all paragraphs of a batch one after the other; runs end with their paragraph
            each = [A.source_tokens(t or "") for t in batch.column(3).to_pylist()]
            scopes, ends = batch.column(2).to_pylist(), np.cumsum([len(w) for w in each])
            hashes = word_hashes([w for words in each for w in words], seen)
            owner = np.repeat(np.arange(len(each)), [len(w) for w in each])
            first, of, anchors, at = ends - [len(w) for w in each], [], [], []
            for size in sizes:
                if len(hashes) < size:
                    continue
                seeds = np.array([seed(size, s) for s in scopes], dtype=np.uint64)
                starts = owner[: len(hashes) - size + 1]
                h = mixed(hashes, seeds[starts], size)
                fits = np.arange(len(h)) + size <= ends[starts]
                if sent is not None:
                    near = np.minimum(np.searchsorted(sent.value, h), max(0, len(sent.value) - 1))
                    fits &= (sent.value[near] == h) if len(sent.value) else False
                here = np.flatnonzero(fits)
                of.append(starts[here])
                anchors.append(h[here])
                at.append(here - first[starts[here]])
            take = pa.array(np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64))
            found = pa.array(np.concatenate([*anchors, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *found], ["doc", "para_no", "anchor", "at"])

    return rows.select("doc", "para_no", "scope", "text").mapInArrow(run, f"doc {kind}, para_no int, anchor bigint, at int")


def merged(windows: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Windows, cut to `size` words, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((max(0, lo), min(hi, size)) for lo, hi in windows):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        elif lo < hi:
            out.append((lo, hi))
    return out


def may_reach(part: list[tuple[str, object]], words: list[str], lo: int, hi: int) -> bool:
    """Whether a window holds enough of a part's literal words for ALTERED."""
    wanted = Counter(w for w, regex in part if regex is None)
    there = Counter(w for w in words[lo:hi] if w in wanted)
    return wanted.total() - (wanted & there).total() <= A.most_edits(len(part))


def placed(parts: list, source: A.Source, windows: dict[int, list[tuple[int, int]]] | None) -> tuple[float, float, list[tuple[int, int]]]:
    """(similarity of the parts in order or 0, nearest similarity, stretch of each part or the one stretch that is nearest).

    Without windows the whole source is searched. Within them nothing that reaches ALTERED is missed; what is less is the nearest there.
    """
    size, flat = len(source.words), [w for part in parts for w in part]
    spans = {n: [(0, size)] if windows is None else merged(windows.get(n, []), size) for n in range(len(parts))}
    if len(parts) == 1:
        for span in spans[0]:  # in order of place, so the first is the one that would be chosen
            first = A.exact(parts[0], source, *span)
            if first is not None:
                return 1.0, 1.0, [(first, first + len(parts[0]))]
    may = {n: [s for s in spans[n] if may_reach(parts[n], source.words, *s)] for n in spans}
    if len(parts) == 1:
        best = max((A.align(parts[0], source, *s) for s in may[0] or spans[0]), key=lambda b: (round(b[0], 9), b[1] - b[2], -b[1]))
        return (best[0] if best[0] >= A.ALTERED - 1e-12 else 0.0), best[0], [best[1:]]
    if all(may.values()):
        got = A.ordered(parts, source, min(s[0] for m in may.values() for s in m), max(s[1] for m in may.values() for s in m))
        if got is not None:
            return got[0], got[0], got[1]
    near = merged([s for m in spans.values() for s in m], size)
    best = max((A.align(flat, source, *s) for s in near), key=lambda b: (round(b[0], 9), b[1] - b[2], -b[1]))
    return 0.0, best[0], [best[1:]]


FOUND = "tag bigint, doc {doc}, para_no int, similarity double, closest double, used boolean, first int, last int, begins int, ends int, stretches array<struct<first:int,last:int>>"


def found_row(tag, doc, para_no, quote: str, words: list[str], chars: list[tuple[int, int]], source: A.Source, windows):
    parts, used = A.segments(quote)
    if not parts or not words:
        return None
    similarity, closest, spans = placed(parts, source, windows)
    first, last = spans[0][0], spans[-1][1]
    begins, ends = (chars[first][0], chars[last - 1][1]) if last > first else (0, 0)
    return tag, doc, para_no, similarity, closest, used, first, last, begins, ends, [{"first": a, "last": b} for a, b in spans]


class Words:
    """Words of the last paragraphs that a task has read."""

    def __init__(self):
        self.known: OrderedDict = OrderedDict()

    def of(self, text: str):
        if text not in self.known:
            words, chars = A.source_spans(text)
            self.known[text] = words, chars, A.Source(words)
            if len(self.known) > KEPT:
                self.known.popitem(last=False)
        return self.known[text]


def frame(rows: list, schema: str):
    import pandas as pd

    return pd.DataFrame([r for r in rows if r is not None], columns=[c.strip().split(" ")[0] for c in schema.split(", ")])


def rank(row: tuple):
    """The order of FOUND rows of a quote, the best one last: in a tie the smaller document and paragraph are better."""
    return round(row[3], 9), round(row[4], 9), _less(row[1]), -row[2]


def in_windows(candidates: DataFrame, schema: str) -> DataFrame:
    """FOUND rows of candidates (tag, doc, para_no, quote, text, windows): of each batch a quote's best only.

    Once a quote stands somewhere as it is, nothing behind that place can be better, and isn't aligned.
    """

    def run(batches):
        known, sure = Words(), {}
        for pdf in batches:
            best: dict = {}
            for x in pdf.sort_values(["doc", "para_no"]).itertuples(index=False):
                if x.tag in sure and sure[x.tag] <= (x.doc, x.para_no):
                    continue
                windows: dict[int, list] = {}
                for w in x.windows:
                    windows.setdefault(w["part"], []).append((w["lo"], w["hi"]))
                row = found_row(x.tag, x.doc, x.para_no, x.quote, *known.of(x.text), windows)
                if row and (x.tag not in best or rank(row) > rank(best[x.tag])):
                    best[x.tag] = row
                if row and row[3] == 1.0:
                    if len(sure) > SURE:
                        sure.clear()
                    sure[x.tag] = x.doc, x.para_no
            yield frame(list(best.values()), schema)

    return candidates.select("tag", "doc", "para_no", "quote", "text", "windows").mapInPandas(run, schema)


def everywhere(asked: list[tuple], rows: DataFrame, schema: str) -> DataFrame:
    """FOUND rows of quotes (tag, scope, quote), LOOSE at most, against all paragraphs: of each batch a quote's best only."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for pdf in batches:
            best: dict = {}
            for doc, para_no, scope, text in pdf.itertuples(index=False):
                words, chars = A.source_spans(text or "")
                source = A.Source(words)
                for tag, own, quote in sent.value:
                    if own != scope:
                        continue
                    row = found_row(tag, doc, para_no, quote, words, chars, source, None)
                    if row and (tag not in best or rank(row) > rank(best[tag])):
                        best[tag] = row
            yield frame(list(best.values()), schema)

    return rows.select("doc", "para_no", "scope", "text").mapInPandas(run, schema)


class _less:
    """Turns the order of ids around."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return self.value > other.value

    def __eq__(self, other):
        return self.value == other.value


def best_places(quotes: DataFrame, rows: DataFrame) -> DataFrame:
    """(tag, words, used, best): the nearest place of each quote (tag, scope, quote) among paragraphs (doc, para_no, scope, text), null without one.

    The similarity in order counts first, then the nearest; ties go to the smaller document and paragraph. Every quote has its row.
    """
    spark, schema = rows.sparkSession, FOUND.format(doc=rows.schema["doc"].dataType.simpleString())
    asked = stored(parsed(quotes), "quotes")
    anchors = asked.where(~F.col("loose")).select("tag", F.explode("anchors").alias("a")).select("tag", "a.*")
    distinct = anchors.select("anchor").distinct()
    few = distinct.count() <= SENT
    known = None
    if few:
        import numpy as np

        known = np.sort(np.array([r[0] for r in distinct.collect()], dtype=np.int64))  # SENT numbers at most
    met = postings(rows, known).join(anchors, "anchor")
    window = F.struct("part", (F.col("at") - F.col("before")).alias("lo"), (F.col("at") + F.col("after")).alias("hi"))
    # a pair's windows are no more than the places in its paragraph
    met = met.groupBy("tag", "doc", "para_no").agg(F.collect_set(window).alias("windows"))
    found = in_windows(met.join(rows.select("doc", "para_no", "text"), ["doc", "para_no"]).join(quotes.select("tag", "quote"), "tag"), schema)
    loose = quotes.join(asked.where("loose").select("tag"), "tag", "left_semi").select("tag", "scope", "quote")
    parts = -(-loose.count() // LOOSE)
    for n in range(parts):
        block = loose if parts == 1 else loose.where(F.pmod(F.xxhash64("tag"), F.lit(parts)) == n)
        found = found.unionByName(everywhere([tuple(r) for r in block.collect()], rows, schema))
    row = F.struct(*[c for c in found.columns if c != "tag"])
    # numbers of whole rows order documents; so a tie's winner is the same however rows are dealt
    tie = F.struct(F.round("similarity", 9), F.round("closest", 9))
    top = found.groupBy("tag").agg(F.max(tie).alias("top"))
    best = found.join(top, "tag").where(tie == F.col("top")).groupBy("tag").agg(F.min_by(row, F.struct("doc", "para_no")).alias("best"))
    return asked.select("tag", "words", "used").join(best, "tag", "left")


def checked(quotes: DataFrame, rows: DataFrame, key: str = "item_id", scope: str | None = None) -> DataFrame:
    """A row for each quote: key, verdict, similarity, doc, para_no, begins, ends, evidence, diff-ready stretches, notes, status.

    quotes: (key, quote) and, where there are any, the scope, `pinpoint` (text) and `semantic` (best similarity of meaning). rows: paragraphs
    (doc, para_no, text) and, where there are any, the scope and `page`. With a scope a quote is held against the paragraphs of its own scope only.
    Null, empty and wordless quotes aren't found, by EMPTY_QUOTE; without a paragraph that isn't blank (in the scope) the source isn't available.
    Null and repeated keys keep their rows. `begins` and `ends` are characters of the paragraph as it is; null where nothing is near.
    """
    given = lambda df, name, kind: F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    within = lambda df: F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    asked = quotes.select(
        F.monotonically_increasing_id().alias("tag"), F.col(key).alias("key"), "quote", within(quotes).alias("scope"), given(quotes, "pinpoint", "string").alias("pinpoint"), given(quotes, "semantic", "double").alias("semantic")
    )
    asked = stored(asked, "asked")
    held = rows.select("doc", "para_no", within(rows).alias("scope"), "text", given(rows, "page", "int").alias("page"))
    found = best_places(asked, held)
    there = held.where(F.col("text").rlike(r"\S")).select("scope").distinct().withColumn("has", F.lit(True))
    out = asked.join(found, "tag").join(there, "scope", "left")
    pages = held.select(F.col("doc").alias("p_doc"), F.col("para_no").alias("p_no"), "page", "text")
    out = out.join(pages, (F.col("best.doc") == F.col("p_doc")) & (F.col("best.para_no") == F.col("p_no")), "left")
    similarity, semantic, words = F.coalesce("best.similarity", F.lit(0.0)), F.col("semantic"), F.col("words")
    verdict = quote_ladder(similarity, F.col("used"), F.coalesce("has", F.lit(False)), words, F.coalesce(semantic, F.lit(-1.0)))
    out = out.withColumn("verdict", verdict)
    shown = F.when(F.col("verdict") == "PARAPHRASE_IN_QUOTES", semantic).when(F.col("verdict") == "SOURCE_UNAVAILABLE", 0.0).otherwise(F.coalesce("best.closest", F.lit(0.0)))
    return out.select(
        F.col("key").alias(key), "quote", "verdict", F.round(shown, 4).alias("similarity"), F.col("best.doc").alias("doc"), F.col("best.para_no").alias("para_no"), F.col("best.begins").alias("begins"),
        F.col("best.ends").alias("ends"), F.expr("substring(text, best.begins + 1, best.ends - best.begins)").alias("evidence"), F.col("text").alias("paragraph"), F.col("best.stretches").alias("stretches"),
        quote_notes(F.col("verdict"), words, semantic, pinpoint_page(F.col("pinpoint")), F.col("page")).alias("notes"), semantic_status(F.col("verdict"), words, semantic).alias("status"),
    )


DIFFED = "part int, operation string, quote_words array<string>, source_words array<string>"


@F.udtf(returnType=DIFFED)
class WordDiff:
    """Rows (part, operation, quote_words, source_words) of a quote against stretches of a paragraph's words."""

    def eval(self, quote: str, paragraph: str, stretches: list):
        if quote is None or paragraph is None or stretches is None:
            return
        parts, words = A.segments(quote)[0], A.source_tokens(paragraph)
        if len(parts) != len(stretches):  # the nearest of all parts together
            parts = [[w for part in parts for w in part]]
        yield from A.diff_rows(parts, [words[s["first"] : s["last"]] for s in stretches])


def diffs(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, doc, para_no, part, operation, quote_words, source_words) of `checked` rows, by a lateral join; what an ellipsis leaves out is in none."""
    from pyspark.sql.functions import col

    there = rows.where(col("stretches").isNotNull())
    return there.lateralJoin(WordDiff(col("quote").outer(), col("paragraph").outer(), col("stretches").outer())).select(key, "doc", "para_no", "part", "operation", "quote_words", "source_words")


def benchmark_checked(spark: SparkSession, d: str) -> DataFrame:
    """Each line of each passage as a quote against the paragraphs of all documents; a passage without lines is one quote."""
    lines = F.when(F.coalesce("text", F.lit("")) == "", F.array(F.lit(None).cast("string"))).otherwise(F.split("text", "\n"))
    asked = read(spark, d, "benchmark").select("item_id", F.posexplode(lines).alias("line", "quote")).select(F.struct("item_id", "line").alias("key"), "quote")
    rows = paragraphs(read(spark, d, "documents"), "\n").select(F.col("doc_id").alias("doc"), "para_no", "text")
    return checked(asked, rows, "key").select("key.*", "*").drop("key")


@query()
def quote_verdict_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return benchmark_checked(spark, d).select("item_id", "line", "verdict", "similarity", "doc", "para_no", "begins", "ends")


@query()
def quote_verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    return benchmark_checked(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query()
def quote_word_diff(spark: SparkSession, d: str) -> DataFrame:
    """Word by word, what turns each line of a passage into the nearest stretch of a document."""
    rows = diffs(benchmark_checked(spark, d).withColumn("key", F.struct("item_id", "line")), "key")
    joined = lambda c: F.array_join(c, " ")
    return rows.select("key.*", "doc", "para_no", "part", "operation", joined("quote_words").alias("quoted"), joined("source_words").alias("source"))
