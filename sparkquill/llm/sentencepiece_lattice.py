"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units at places that no piece of the vocabulary goes across. For each distinct unit all substrings
of bounded length are exploded and equi-joined to the piece table; the edges found are grouped by unit and folded
with Spark's higher-order ``aggregate``. The model at hand is of the BPE kind: its best path is not that of the largest
sum of scores but that of the merges in order of score. So the fold goes over the edges in that order, as Viterbi's goes
over them by end, with the set of cuts as its state: an edge is taken when both its ends are cuts and one cut is
between. Characters without a piece fall back to their bytes.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import stored, table

#: Units up to this many characters are folded; their cuts are the bits of a long. Longer ones go to the library.
LONGEST = 60
NONE = (1 << 21) - 1
#: Units whose edges one task groups: few enough that they stay in memory.
UNITS_EACH = 20_000
#: Most units whose pieces are broadcast to where their texts are: of a sample of texts (SAMPLED on average), and of all that it lacks.
FREQUENT, SECOND, SAMPLED = 200_000, 400_000, 16_000
#: Before a run of spaces, around a line break, and before a full stop or comma that follows a small letter.
CUT = r"(?=[ \n.,])(?:(?<=[^ ])(?= )|(?=\n)|(?<=[a-zà-ÿ])(?=[.,]))|(?<=\n)"


class Pieces:
    """The piece table of a model: rows for the join, and bytes of each id for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        text = {i: lib.id_to_piece(i).replace("▁", " ") for i in plain}
        if any(re.search("[^ ] |\n|[a-zà-ÿ][.,]", t) for t in text.values()):
            raise ValueError("a piece goes across a place where texts are cut")
        self.path, self.longest = path, max(map(len, text.values()))
        self.rows = [(text[i], i, -round(lib.get_score(i))) for i in plain]
        self.first_byte = next(i for i in range(n) if lib.is_byte(i))
        self.hex = [
            text[i].encode().hex() if i in text else f"{i - self.first_byte:02x}" if lib.is_byte(i) else "" for i in range(n)
        ]


def cut_units(text: Column) -> Column:
    """Units of a text, in order, with the space that the model puts in front. None for a null or empty text."""
    whole = F.concat(F.lit(" "), F.replace(text, F.lit("▁"), F.lit(" ")))
    return F.when(F.length(text) > 0, F.split(whole, CUT)).otherwise(F.array().cast("array<string>"))


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """From distinct units in a stored table, which are counted first: (unit, class, edges); each edge is a long of rank, start (6 bits), length (5 bits) and id (21 bits, NONE for a character without a piece)."""
    spark = units.sparkSession
    known = spark.createDataFrame(pieces.rows, "piece string, id bigint, rank bigint")  # as many rows as the model has pieces
    # units are dealt out before they are exploded, so that their edges need no shuffle; into a stated number of parts, as
    # their edges are many times the bytes by which Spark would otherwise join parts
    parts = max(1, -(-units.count() // UNITS_EACH))
    # grouped by a number, not by the unit: a task has more units than the aggregate's hash map holds, and Spark then sorts
    # by the key, which by a single long needs no comparison of strings. A stored table gives the same numbers when read again
    numbered = units.withColumn("no", F.monotonically_increasing_id()).repartition(parts, "no")
    starts = numbered.select("no", "unit", "class", F.explode(F.expr("sequence(0, length(unit) - 1)")).alias("s"))
    spans = starts.select("no", "unit", "class", "s", F.explode(F.expr(f"sequence(1, least({pieces.longest}, length(unit) - s))")).alias("n"))
    spans = spans.withColumn("piece", F.expr("substring(unit, s + 1, n)"))
    edges = spans.join(F.broadcast(known), "piece", "left").where("id is not null or n = 1")
    code = F.expr(f"shiftleft(coalesce(rank, 0L), 32) | shiftleft(cast(s as bigint), 26) | shiftleft(cast(n as bigint), 21) | coalesce(id, {NONE}L)")
    grouped = edges.groupBy("no").agg(F.first("unit").alias("unit"), F.first("class").alias("class"), F.collect_list(code).alias("edges"))
    return grouped.drop("no")


#: Start, length and id of an edge x, and the cuts that it goes over as the low bits of a long.
START, LENGTH, ID = "cast(shiftright(x, 26) & 63 as int)", "cast(shiftright(x, 21) & 31 as int)", f"(x & {NONE}L)"
UNDER = f"(shiftright(cuts, {START}) & (shiftleft(2L, {LENGTH}) - 1))"
ENDS = f"({UNDER} & 1) = 1 and shiftright({UNDER}, {LENGTH}) = 1"


def fold(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, class, ids): the pieces that the fold leaves, in order."""
    cuts = F.expr(
        f"""aggregate(array_sort(filter(edges, x -> (shiftright(x, 21) & 31) > 1)), shiftleft(1L, length(unit) + 1) - 1, (cuts, x) ->
             if(bit_count({UNDER}) = 3 and {ENDS}, cuts & ~shiftleft(shiftleft(1L, {LENGTH}) - 2, {START}), cuts))"""
    )
    left = F.expr(f"array_sort(transform(filter(edges, x -> bit_count({UNDER}) = 2 and {ENDS}), x -> x & 4294967295L))")
    char = f"encode(substring(unit, {START} + 1, 1), 'UTF-8')"
    as_bytes = f"transform(sequence(1, octet_length({char})), i -> {pieces.first_byte} + cast(conv(substring(hex({char}), 2 * i - 1, 2), 16, 10) as int))"
    ids = F.expr(
        f"""if(exists(chosen, x -> {ID} = {NONE}), flatten(transform(chosen, x -> if({ID} = {NONE}, {as_bytes}, array(cast({ID} as int))))),
             transform(chosen, x -> cast({ID} as int)))"""
    )
    return edges.withColumn("cuts", cuts).withColumn("chosen", left).select("unit", "class", ids.alias("ids"))


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, class, ids) for distinct units (unit, class); the class is passed on."""
    path = pieces.path

    @F.pandas_udf("array<int>")
    def by_library(unit):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        # after a line break nothing is put in front; the pieces of ' ' and of the break are cut off
        return unit.map(lambda u: lib.encode(u[1:]) if u[0] == " " and u[1:2] != " " else lib.encode("\n" + u)[2:])

    short = fold(lattice(units.where(F.length("unit") <= LONGEST), pieces), pieces)
    long = units.where(F.length("unit") > LONGEST).select("unit", "class", by_library("unit").alias("ids"))
    return short.unionByName(long)


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of an array of ids, with the space that the model puts in front; ids without text give none."""
    hexes = F.from_json(F.lit(json.dumps(pieces.hex)), "array<string>")
    joined = F.array_join(F.transform(ids, lambda i: F.element_at(hexes, i + 1)), "")
    return F.decode(F.unhex(joined), "UTF-8")


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, unit, ids): the units of each text, in order of pos, with their pieces.

    Null and empty texts have no rows. Repeated rows are encoded each; other columns are not read.
    """
    units = docs.select(F.col(f"`{id_col}`").alias("__id"), F.posexplode(cut_units(F.col(f"`{text_col}`"))).alias("pos", "unit"))
    few = stored(units.select("unit").distinct().withColumn("class", F.lit(0)), "units")
    words = stored(encode_units(few, pieces), "pieces-of-units")
    return units.join(words, "unit").select(F.col("__id").alias(id_col), "pos", "unit", "ids")


def how_often() -> Column:
    """The class of a unit's count: steps of a logarithm."""
    return F.floor(8 * F.log2(F.count("*"))).cast("int").alias("class")


def most_frequent(counts: DataFrame, most: int) -> int:
    """The least class of counts (unit, class, ...) from which on there are `most` short units at most. There are few classes."""
    sizes = counts.where(F.length("unit") <= LONGEST).groupBy("class").agg(F.count("*")).collect()
    least, held = 1 << 30, 0
    for step, n in sorted(sizes, reverse=True):
        held += n
        if held > most:
            break
        least = step
    return least


def frequent_units(docs: DataFrame, text_col: str) -> DataFrame:
    """(unit, class): at most FREQUENT short units that a sample of SAMPLED texts (on average) repeats. They change the speed only, never a row."""
    share = min(1.0, SAMPLED / max(1, docs.count()))
    units = docs.sample(share, seed=1).select(F.explode(cut_units(F.col(f"`{text_col}`"))).alias("unit")).where(F.length("unit") <= LONGEST)
    counts = stored(units.groupBy("unit").agg(how_often()).where("class > 0"), "unit-classes")
    return counts.where(F.col("class") >= most_frequent(counts, FREQUENT))


def unit_facts(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, class, n, h, same) of distinct units: how many pieces, their hash, and whether decoding gives the unit back."""
    ids = F.col("ids")
    return encode_units(units, pieces).select("unit", "class", F.size(ids).alias("n"), F.xxhash64(ids).alias("h"), (decode(ids, pieces) == F.col("unit")).alias("same"))


def encoded_counts(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_units, n_pieces, ids_hash (bit_xor of xxhash64(pos, xxhash64(ids))), round_trip (decoding gives each unit back).

    Rows are told apart by a tag and not by their id, so null ids and repeated rows each keep a row of their own. Null and empty texts have no
    units, hash 0 and a true round trip; an empty table gives no rows; other columns aren't read. What counts as frequent changes no value.
    """
    frequent = stored(unit_facts(stored(frequent_units(docs, text_col), "frequent"), pieces), "frequent-facts")
    text = cut_units(F.col(f"`{text_col}`"))
    rare = docs.select(F.explode(text).alias("unit")).join(F.broadcast(frequent.select("unit")), "unit", "left_anti").groupBy("unit").agg(how_often())
    words = stored(unit_facts(stored(rare, "rare"), pieces), "rare-facts")
    # the sample's units, and of the others those that all texts have most often: FREQUENT and SECOND rows at most
    often = words.where((F.col("class") >= most_frequent(words, SECOND)) & (F.length("unit") <= LONGEST))
    known = F.broadcast(frequent.unionByName(often).drop("class"))
    # each row begins with a null unit, so that a row without frequent units is there too
    lead = F.concat(F.array(F.lit(None).cast("string")), text)
    units = docs.select(F.col(f"`{id_col}`").alias("__id"), lead.alias("__u")).withColumn("__tag", F.monotonically_increasing_id())
    units = units.select("__id", "__tag", F.posexplode("__u").alias("pos", "unit")).withColumn("pos", F.col("pos") - 1)
    near = units.join(known, "unit", "left")
    # texts are gone over once: frequent units are summed by row, each rare one is a group of its own, in one aggregate
    is_rare = F.col("unit").isNotNull() & F.col("n").isNull()
    summed = near.groupBy("__tag", F.when(is_rare, F.col("unit")).alias("rare"), F.when(is_rare, F.col("pos")).alias("pos")).agg(
        F.max(F.when(F.col("unit").isNull(), F.col("__id"))).alias("__id"),
        F.count("unit").alias("n_units"),
        F.sum("n").alias("n_pieces"),
        F.expr("bit_xor(xxhash64(pos, h)) filter (where n is not null)").alias("ids_hash"),
        F.bool_and("same").alias("round_trip"),
    )
    # a sum's key is no unit (those hold a line break alone), and differs by row, so that sums spread over all tasks
    own = summed.withColumn("key", F.coalesce("rare", F.concat(F.lit("\n"), F.col("__tag").cast("string"))))
    both = own.join(words.select(F.col("unit").alias("key"), "n", "h", "same"), "key", "left")
    return both.groupBy("__tag").agg(
        F.max("__id").alias(id_col),
        F.sum("n_units").alias("n_units"),
        F.coalesce(F.sum(F.coalesce("n_pieces", "n")), F.lit(0)).alias("n_pieces"),
        F.coalesce(F.expr("bit_xor(coalesce(ids_hash, xxhash64(pos, h))) filter (where n_units > 0)"), F.lit(0)).alias("ids_hash"),
        F.coalesce(F.bool_and(F.coalesce("round_trip", "same")), F.lit(True)).alias("round_trip"),
    ).drop("__tag")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoded_counts of all documents."""
    import public_tokenizers

    return encoded_counts(table(spark, sf_dir, "documents"), Pieces(public_tokenizers.path("piece_bpe_32k.model")))
