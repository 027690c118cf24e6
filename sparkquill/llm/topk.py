"""Exact top-k inner products by a dual-tree search over cover trees.

Rows and queries are dealt to the nearest of a few pivots, chosen farthest first from a sample; these cells are the upper
level of both trees. A cell with more rows than a block holds is dealt to several blocks by a hash, so no vector, however common,
makes a large one. Each block gets its cover tree once, and is stored with it: a node has a centre of its own points and a covering
radius; centres of its children are chosen farthest first until the children cover it at RATIO of its radius. Where the
dimension is too high for that within BRANCHES children, points go to the nearest centre and the child keeps the radius that it
really has, so bounds hold in any case. A pair of nodes is pruned when the largest inner product that the two radii allow is
below the worst kth score of the query group. The same holds between blocks: each query block is searched against its most
promising row blocks first, and the kth scores found there prune its other block pairs before any vector of theirs is copied.
"""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkquill.llm.common import stored, table

#: Rows of a block, and queries of one.
BLOCK, ASKED = 8192, 4096
#: Most pivots, and vectors that they are chosen from.
PIVOTS, SAMPLE = 256, 4096
#: Row blocks that a query block is searched against before its other pairs are pruned; block summaries that are compared at once.
FIRST, SUMMARIES = 4, 2048
RATIO, BRANCHES = 1 / 1.3, 16
#: Block pairs that share one fetch of a tree, about.
TOGETHER = 16
LEAF = {"row": 1024, "query": 256}


class Tree:
    """Points in tree order, and nodes as lists: first and last point, centre, radius, children."""

    def __init__(self, ids, points, leaf: int):
        import numpy as np

        self.ids, self.points, self.leaf = ids, points, leaf
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.root = self.build(0, len(ids))
        self.ids, self.points = ids[self.order], points[self.order]

    def build(self, lo: int, hi: int) -> int:
        import numpy as np

        rows = self.order[lo:hi]
        x = self.points[rows]
        centre = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()]
        far = np.sqrt(((x - centre) ** 2).sum(axis=1))
        radius, children = float(far.max()), []
        if hi - lo > self.leaf and radius > 0:
            owner, near = np.zeros(len(rows), dtype=np.int64), far.copy()
            count = 1
            while count < BRANCHES and near.max() > radius * RATIO:
                to = np.sqrt(((x - x[near.argmax()]) ** 2).sum(axis=1))
                owner[to < near], near = count, np.minimum(near, to)
                count += 1
            self.order[lo:hi] = rows[np.argsort(owner, kind="stable")]
            ends = lo + np.cumsum(np.bincount(owner, minlength=count))
            spans = [(a, b) for a, b in zip([lo, *ends[:-1].tolist()], ends.tolist()) if b > a]
            if len(spans) > 1:
                children = [self.build(a, b) for a, b in spans]
        self.nodes.append((lo, hi, centre, radius, float(np.sqrt((centre**2).sum())), children))
        return len(self.nodes) - 1


def bound(q: tuple, r: tuple) -> float:
    """The largest inner product that points of two nodes can have, and a little more for rounding."""
    return float(q[2] @ r[2]) + q[3] * r[4] + r[3] * q[4] + q[3] * r[3] + 1e-6 + 1e-12 * (q[3] + q[4]) * (r[3] + r[4])


def search(queries: Tree, rows: Tree, k: int, floor=None, seen: dict | None = None):
    """(queries, best ids, best scores), k for each query; ties go to smaller ids.

    Scores under a query's `floor`, k of which are known to reach it, aren't looked for. `seen` counts leaf pairs that were scored.
    """
    import numpy as np

    n = len(queries.ids)
    scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    floor = np.full(n, -np.inf) if floor is None else floor

    def base(q: tuple, r: tuple) -> None:
        found = queries.points[q[0] : q[1]] @ rows.points[r[0] : r[1]].T
        found[queries.ids[q[0] : q[1], None] == rows.ids[None, r[0] : r[1]]] = -np.inf
        if seen is not None:
            seen["scored"] = seen.get("scored", 0) + 1
        worst = np.maximum(scores[q[0] : q[1], -1], floor[q[0] : q[1]])
        hit = np.flatnonzero((found >= worst[:, None]).any(axis=1) & (found > -np.inf).any(axis=1))
        if len(hit):
            take = found[hit]
            if take.shape[1] > k:  # ties of the kth are kept, so that ids decide below
                kth = -np.partition(-take, k - 1, axis=1)[:, k - 1 : k]
                wide = int((take >= kth).sum(axis=1).max())
                part = np.argpartition(-take, wide - 1, axis=1)[:, :wide] if wide < take.shape[1] else np.tile(np.arange(wide), (len(hit), 1))
                take, new = np.take_along_axis(take, part, 1), rows.ids[r[0] : r[1]][part]
            else:
                new = np.broadcast_to(rows.ids[r[0] : r[1]], take.shape)
            at = hit + q[0]
            all_scores, all_ids = np.concatenate([scores[at], take], 1), np.concatenate([ids[at], new], 1)
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[at], ids[at] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)

    def visit(q: tuple, r: tuple) -> None:
        if bound(q, r) < np.maximum(scores[q[0] : q[1], -1], floor[q[0] : q[1]]).min():
            return
        if not q[5] and not r[5]:
            base(q, r)
        elif q[5] and (not r[5] or q[3] >= r[3]):
            for c in q[5]:
                visit(queries.nodes[c], r)
        else:
            for c in sorted((rows.nodes[c] for c in r[5]), key=lambda c: -bound(q, c)):
                visit(q, c)

    if n and len(rows.ids):
        visit(queries.nodes[queries.root], rows.nodes[rows.root])
    return queries.ids, ids, scores


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(vectors, width: int):
    """Vectors as rows of one matrix, filled up with zeros."""
    import numpy as np

    points = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        points[i, : len(v)] = v
    return points


def pivots(good: DataFrame, n: int, width: int):
    """n vectors of a sample, each the farthest from those before it. The sample: of the distinct rows those of the least hashes, SAMPLE at most.

    Hashes are cut where about twice as many rows are left, so what comes to the driver has that bound whatever the number of partitions.
    """
    import numpy as np

    if n <= 1:
        return np.zeros((1, width))
    hashed = good.select("__v", F.xxhash64("__id", "__v").alias("h"))
    distinct = hashed.agg(F.approx_count_distinct("h")).first()[0]
    share = F.shiftrightunsigned("h", 1) / float(1 << 63)
    few = hashed.where(share < 2 * SAMPLE / max(1, distinct)).groupBy("h").agg(F.min("__v").alias("__v")).collect()
    least = sorted(few, key=lambda r: r["h"])[:SAMPLE]
    sample = np.unique(matrix([r["__v"] for r in least], width), axis=0)
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def celled(rows: DataFrame, centres, width: int) -> DataFrame:
    """rows (__id, __v) with __c, the number of the nearest centre."""
    if len(centres) == 1:
        return rows.select("__id", "__v", F.lit(0).alias("__c"))
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # PIVOTS vectors at most

    def run(batches):
        import numpy as np

        c = sent.value
        for pdf in batches:
            x = matrix(list(pdf["__v"]), width)
            cells = [((c**2).sum(axis=1) - 2 * x[i : i + 1024] @ c.T).argmin(axis=1) for i in range(0, len(x), 1024)]
            yield pdf.assign(__c=np.concatenate(cells).astype(np.int32) if cells else np.zeros(0, np.int32))

    return rows.select("__id", "__v").mapInPandas(run, "__id bigint, __v array<double>, __c int")


def blocks(rows: DataFrame, most: int, width: int, leaf: int, name: str) -> DataFrame:
    """(no, centre, radius, tree) of rows (__id, __v, __c), stored: cells of over `most` rows are dealt to several blocks by a hash."""
    rows = stored(rows.withColumn("__copy", F.monotonically_increasing_id()), f"{name}-cells")
    parts = {r[0]: -(-r[1] // most) for r in rows.groupBy("__c").count().collect()}  # PIVOTS rows at most
    first, total = {}, 0
    for cell, n in sorted(parts.items()):
        first[cell], total = total, total + n
    plan = rows.sparkSession.createDataFrame([(c, first[c], parts[c]) for c in parts], "__c int, __from int, __parts int")
    dealt = rows.join(F.broadcast(plan), "__c").select("__id", "__v", (F.col("__from") + F.pmod(F.xxhash64("__id", "__copy"), "__parts")).cast("int").alias("no"))

    def build(pdf):
        import numpy as np
        import pandas as pd

        order = np.argsort(pdf["__id"].to_numpy(), kind="stable")
        tree = Tree(pdf["__id"].to_numpy(dtype=np.int64)[order], matrix(list(pdf["__v"]), width)[order], leaf)
        root = tree.nodes[tree.root]
        return pd.DataFrame({"no": [int(pdf["no"].iloc[0])], "centre": [root[2]], "radius": [root[3]], "tree": [pickle.dumps(tree)]})

    return stored(dealt.groupBy("no").applyInPandas(build, "no int, centre array<double>, radius double, tree binary"), f"{name}-blocks")


def block_pairs(rows: DataFrame, asks: DataFrame, floors: DataFrame | None, first: int | None) -> DataFrame:
    """(q, r) of blocks to be searched: the `first` most promising row blocks of each query block, or those that its floor leaves.

    Only summaries are compared, SUMMARIES row blocks at once: they meet the query blocks by an equi-join on the number of their group.
    """
    groups = rows.select(F.floor(F.col("no") / SUMMARIES).cast("int").alias("g"), F.struct("no", "centre", "radius").alias("s"))
    groups = groups.groupBy("g").agg(F.collect_list("s").alias("s"))
    asked = asks.select("no", "centre", "radius")
    asked = asked.withColumn("floor", F.lit(float("-inf"))) if floors is None else asked.join(floors, "no")
    count = max(1, -(-rows.count() // SUMMARIES))
    met = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(groups, "g").select("no", "centre", "radius", "floor", "s")

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for x in pdf.itertuples():
                centre = np.array(x.centre)
                far, radii = np.array([list(s["centre"]) for s in x.s]), np.array([s["radius"] for s in x.s])
                size, sizes = np.sqrt((centre**2).sum()), np.sqrt((far**2).sum(axis=1))
                best = far @ centre + x.radius * sizes + radii * size + radii * x.radius + 1e-6 + 1e-12 * (size + x.radius) * (sizes + radii)
                keep = best >= x.floor
                yield pd.DataFrame({"q": x.no, "r": np.array([s["no"] for s in x.s])[keep], "best": best[keep]})

    pairs = met.mapInPandas(run, "q int, r int, best double")
    if first is not None:
        order = Window.partitionBy("q").orderBy(F.desc("best"), "r")
        pairs = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    return pairs.select("q", "r")


def dealt(pairs: DataFrame, side: str, other: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(pairs with a part number, the parts of each block of a side): a block's pairs are dealt to parts of about `most` by the other side's number."""
    parts = pairs.groupBy(side).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts"))
    part = F.pmod(F.xxhash64(other), F.col("__parts")).cast("int")
    each = parts.select(side, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("part"))
    return pairs.join(parts, side).select(*pairs.columns, part.alias("part")), each


def searched(pairs: DataFrame, rows: DataFrame, asks: DataFrame, k: int, floors: DataFrame | None) -> DataFrame:
    """(q, query_id, __id, score): each query's k best rows of each block pair, at its floor or above.

    Pairs are numbers until their trees are met: parts of a query block's pairs fetch its tree first, then parts of a row block's pairs
    are brought together with that block's tree, once for TOGETHER query blocks. A part is a group of its own, so no block's pairs are one task.
    """
    of_query, parts = dealt(pairs, "q", "r", TOGETHER)
    given = asks.select(F.col("no").alias("q"), F.col("tree").alias("q_tree"))
    if floors is not None:
        given = given.join(floors.select(F.col("no").alias("q"), "floors"), "q", "left")
    else:
        given = given.withColumn("floors", F.lit(None).cast("map<bigint,double>"))
    asked = of_query.join(parts.join(given, "q"), ["q", "part"]).select("q", "r", "q_tree", "floors")
    _, row_parts = dealt(pairs, "r", "q", TOGETHER)
    counts = row_parts.groupBy("r").agg(F.count("*").cast("int").alias("__parts"))
    asked = asked.join(counts, "r").select("q", "r", F.pmod(F.xxhash64("q"), F.col("__parts")).cast("int").alias("part"), "q_tree", "floors")
    trees = row_parts.join(rows.select(F.col("no").alias("r"), F.col("tree").alias("r_tree")), "r").select(F.col("r").alias("t_r"), F.col("part").alias("t_part"), "r_tree")

    def run(pdf, tree_pdf):
        import numpy as np
        import pandas as pd

        out = []
        tree = pickle.loads(tree_pdf["r_tree"].iloc[0]) if len(tree_pdf) and len(pdf) else None
        for x in pdf.itertuples():
            mine = pickle.loads(x.q_tree)
            known = dict(x.floors) if x.floors is not None else {}
            floor = np.array([known.get(int(i), -np.inf) for i in mine.ids])
            of, best, scores = search(mine, tree, k, floor)
            there = scores > -np.inf
            out.append(pd.DataFrame({"q": np.int32(x.q), "query_id": np.repeat(of, k)[there.ravel()], "__id": best[there], "score": scores[there].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "query_id": [], "__id": [], "score": []}).astype({"q": "int32", "query_id": "int64", "__id": "int64", "score": "int64"})

    return asked.groupBy("r", "part").cogroup(trees.groupBy("t_r", "t_part")).applyInPandas(run, "q int, query_id bigint, __id bigint, score bigint")


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Each query's k best rows: query_id, rank, id, score; score is the inner product of floor(scale * component).

    `queries` tells which rows are queries; a query's own id is no candidate for it, whichever row has it. Rows whose id is null, or whose
    vector is null or holds null or non-finite components, take no part. Vectors shorter than others count as filled up with
    zeros. Rows that repeat an id are candidates each; a query id that repeats is asked once, with the least of its vectors (compared
    component by component). Empty tables give no rows; other columns aren't read.
    """
    v = F.col(f"`{vector_col}`")
    good = stored(
        vectors.where(usable(v) & F.col(f"`{id_col}`").isNotNull()).select(
            F.col(f"`{id_col}`").cast("bigint").alias("__id"),
            queries.alias("__asks"),
            F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("__v"),
        ),
        "vectors",
    )
    n, width = good.agg(F.count("*"), F.max(F.size("__v"))).first()
    width = max(1, width or 0)
    centres = pivots(good, min(PIVOTS, max(1, n // BLOCK)), width) if n else None
    if centres is None:
        return good.select(F.col("__id").alias("query_id"), F.lit(1).alias("rank"), F.col("__id").alias(id_col), F.lit(0).cast("bigint").alias("score")).limit(0)
    rows = blocks(celled(good, centres, width), BLOCK, width, LEAF["row"], "row")
    asked = good.where("__asks").groupBy("__id").agg(F.min("__v").alias("__v"))
    asks = blocks(celled(asked, centres, width), ASKED, width, LEAF["query"], "query")
    near = stored(block_pairs(rows, asks, None, FIRST), "near-pairs")
    found = stored(searched(near, rows, asks, k, None), "near-found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "__id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the kth score of each query that has k by now; its group's floor is the worst of these, none if one has fewer
    kth = best.groupBy("q", "query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(float("-inf")).alias("kth"))
    floors = kth.groupBy(F.col("q").alias("no")).agg(
        F.min("kth").alias("floor"), F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("floors")
    )
    floors = stored(asks.select("no").join(floors, "no", "left").select("no", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "floors"), "floors")
    left = stored(block_pairs(rows, asks, floors.select("no", "floor"), None).join(near, ["q", "r"], "left_anti"), "left-pairs")
    more = searched(left, rows, asks, k, floors)
    return (
        best.select("query_id", "__id", "score").unionByName(more.select("query_id", "__id", "score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("__id").alias(id_col), "score")
    )


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
