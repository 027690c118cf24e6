"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into RING segments in a ring. If two fingerprints differ in at most K bits, then from some
segment on, every chain of the next l segments differs in at most l * K / RING bits (the strong form of the
pigeonhole principle). Chains of two are met by an equi-join: the first segment is equal and the second differs
in at most one bit, which one side tries out. Chains of three are filtered next, and the full Hamming check is last.
Links join distinct fingerprints only; documents with one fingerprint are one class from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import packed, stored, table, text_chunks, unpacked

K = 3
RING = 4
WIDTH = 64 // RING
SHINGLE = 3
SEED = 42
#: A class with a HOT-th of all rows is settled by broadcast; there are at most HOT of them.
HOT = 500
#: Fingerprints of one chain that a join task meets at once; a chain with more is dealt to several.
CROWD = 4096
#: Shingles whose bits are counted at once.
SLICE = 1 << 17


def fingerprint(text: str | None) -> int:
    """SimHash of one text; the counts are taken in slices, so a long text needs no more memory than its words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    one, n = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        span = range(at, min(at + SLICE, n))
        hashes = np.array([one(b" ".join(words[i : i + SHINGLE]), SEED) for i in span], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __key, __fp): the fingerprint of each row's whole text, as a signed long; __key is a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in text_chunks(batches):
            found = np.array([fingerprint(t) for t in part.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], ["__id", "__key", "__fp"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__key"), text.alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, __key bigint, __fp bigint")


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % RING)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("bigint"))


def chain(fp: Column, i: int) -> Column:
    """Segment number i, itself and the next one, as one long."""
    first = F.shiftleft(segment(fp, i), WIDTH).bitwiseOR(segment(fp, i + 1))
    return first.bitwiseOR(F.lit(i << (2 * WIDTH)).cast("bigint"))


def in_chain(apart: Column, at: Column, length: int) -> Column:
    """Bits of apart within `length` segments from segment number `at` on."""
    count = F.lit(None)
    for i in range(RING):
        mask = sum(((1 << WIDTH) - 1) << (WIDTH * ((i + j) % RING)) for j in range(length))
        mask -= (1 << 64) if mask >> 63 else 0
        count = F.when(at == i, F.bit_count(apart.bitwiseAND(F.lit(mask).cast("bigint")))).otherwise(count)
    return count


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints __fp that differ in at most K bits."""
    chains = F.explode(F.array(*[chain(F.col("__fp"), i) for i in range(RING)])).alias("__chain")
    flips = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, *(1 << b for b in range(WIDTH)))])).alias("__flip")
    plain = nodes.select(F.col("__fp").alias("b"), chains)
    # a chain that many fingerprints share is dealt to parts of CROWD of them; whoever tries it meets every part
    crowded = stored(plain.groupBy("__chain").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("__chain", F.ceil(F.col("n") / CROWD).alias("parts")), "crowded")
    plain = plain.join(crowded, "__chain", "left").select("b", "__chain", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).alias("__part"))
    tried = (
        nodes.select(F.col("__fp").alias("a"), chains)
        .select("a", "__chain", flips)
        .select("a", F.col("__chain").bitwiseXOR(F.col("__flip")).alias("__chain"))
    )
    tried = tried.join(crowded, "__chain", "left").select("a", "__chain", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)).alias("__part"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    at = F.shiftrightunsigned(F.col("__chain"), 2 * WIDTH)
    near = [in_chain(apart, at, n) <= n * K // RING for n in range(3, RING)]
    # Spark sizes both sides as the nodes they are exploded from, and would send one of them to the driver for a broadcast
    return (
        tried.join(plain.hint("merge"), ["__chain", "__part"])
        .where(F.col("a") < F.col("b"))
        .where(near[0])
        .where(F.bit_count(apart) <= K)
        .select("a", "b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges (a, b).

    Min-label hooking with pointer jumping. Each round is written to the shared folder; it ends when no label changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), "links")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other")
            .groupBy("node")
            .agg(F.min("seen").alias("seen"))
        )
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(
            hooked.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")),
            "labels",
        )
        labels = new.select("node", "root")
        if not new.where("root <> was").head(1):
            return labels


def own() -> Column:
    """(missing, id, key) of a row, by which rows of a class are ordered."""
    return F.struct(F.col("__id").isNull().alias("missing"), F.col("__id").alias("id"), F.col("__key").alias("key"))


def settled(prints: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Rows (__id, __key, __fp) with __first (missing, id, key), which names the row of their class that stays."""
    nodes = stored(prints.groupBy("__fp").agg(F.min(own()).alias("__own"), F.count("*").alias("__size")), "classes")
    roots = components(links(nodes.select("__fp"))) if roots is None else roots
    named = nodes.join(roots, nodes["__fp"] == roots["node"], "left").select(
        "__fp", "__own", "__size", F.coalesce("root", "__fp").alias("__root")
    )
    least = named.where("__root is not null").groupBy("__root").agg(F.min("__own").alias("__first"))
    of = stored(named.join(least, "__root").select("__fp", "__size", "__first"), "class-components")
    total = nodes.agg(F.sum("__size")).first()[0] or 0
    # at most HOT classes hold a HOT-th of all rows, so these can be broadcast; their rows aren't shuffled
    hot = of.where(F.col("__size") * HOT >= F.lit(total)).select("__fp", F.col("__first").alias("__hot"))
    split = prints.join(F.broadcast(hot), "__fp", "left")
    fixed = split.where(F.col("__hot").isNotNull()).select("__id", "__key", "__fp", F.col("__hot").alias("__first"))
    rest = split.where(F.col("__hot").isNull()).join(of, "__fp").select("__id", "__key", "__fp", "__first")
    return fixed.unionByName(rest)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __key, __fp, __first) for each row of docs; __first (missing, id, key) names the row that stays."""
    return settled(stored(fingerprints(docs, id_col, text_col), "fingerprints"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id that links reach).

    Null, empty and blank texts have fingerprint zero, linked like any other. Null ids are passed over in
    component_id unless a component has no other. Repeated rows each give a row; an empty table gives none.
    """
    return classes(docs, id_col, text_col).select(
        F.col("__id").alias(id_col),
        F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"),
        F.col("__first.id").alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rows whose component has a row of smaller id (ties: by a hash of the text; full repeats share a fate)."""
    return without(docs, classes(docs, id_col, text_col), id_col, text_col)


def without(docs: DataFrame, of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that `of` (__id, __key, __first) says aren't the first of their class."""
    lost = of.where(own() != F.col("__first")).select("__id", "__key").distinct()
    rows = packed(docs, __i=F.col(f"`{id_col}`"), __k=F.xxhash64(F.col(f"`{text_col}`")))
    return unpacked(rows.join(lost, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")), "left_anti"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
