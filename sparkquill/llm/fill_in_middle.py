"""Fill-in-the-middle transformation by DuckDB inside mapInArrow.

Each Arrow batch is registered with an in-memory database of the task; SQL cuts the texts into units with
regexp_extract_all, takes prefix, middle and suffix with list_slice and array_to_string, and draws from sha256 of seed and id.
Rows go in and out as Arrow; nothing is done row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import table, text_chunks

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units: a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED, RATE, SPM_RATE = 42, 50, 80

CUT = f"""
WITH drawn AS (SELECT id, coalesce(t, '') AS t, sha256('{{seed}}:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM batch),
numbers AS (SELECT id, t, regexp_extract_all(t, '{UNIT}') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
cuts AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {{rate}} THEN 'plain' WHEN h4 % 100 < {{spm}} THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
pieces AS (SELECT id, t, n, form, CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, 1, a), ''), '') END AS p,
    CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') END AS m,
    CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') END AS s FROM cuts)
SELECT id, CAST(n AS BIGINT) AS n, form, CAST(length(p) AS BIGINT) AS prefix_chars, CAST(length(m) AS BIGINT) AS middle_chars,
    CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output
FROM pieces"""
#: A mark has no ending that begins it, and texts that hold one are plain; so the first place of each is where it was put.
JOIN = f"""
SELECT *, CASE {{form}} WHEN 'plain' THEN o
    WHEN 'psm' THEN substr(split_part(o, '{SUFFIX}', 1), {len(PREFIX) + 1}) || split_part(o, '{MIDDLE}', 2) || split_part(split_part(o, '{SUFFIX}', 2), '{MIDDLE}', 1)
    ELSE split_part(split_part(o, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(o, '{MIDDLE}', 2) || substr(split_part(o, '{PREFIX}', 1), {len(SUFFIX) + 1}) END AS restored
FROM batch"""


def by_sql(sql: str, names: list[str]):
    """A function for mapInArrow: runs `sql` over each slice of the batches, registered as `batch` with columns of these names, the last one texts."""

    def run(batches):
        import duckdb
        import pyarrow as pa

        # one thread, as Spark runs a task on each core; nothing is written to a local folder
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as base:
            for part in text_chunks(batches, 2 << 20):
                base.register("batch", pa.Table.from_arrays(part.columns, names))
                yield from base.sql(sql).to_arrow_table().to_batches()
                base.unregister("batch")

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per input row: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    Null texts count as empty; empty texts, and texts that hold a mark, are plain. `rate` of 100 texts are drawn, and `spm_rate` of 100 of
    these become spm. A null id draws as an empty one; repeated rows draw alike and keep their rows; an empty table gives none; other
    columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sql = CUT.format(seed=int(seed), rate=int(rate), spm=int(spm_rate))
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    out = rows.mapInArrow(by_sql(sql, ["id", "t"]), f"__id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("__id", id_col)


def restore(rows: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """rows with column `restored`: the text that form and output stand for. Null outputs give null; other columns are passed on."""
    others = [c for c in rows.columns if c != output_col]
    names = [f"c{i}" for i in range(len(others))]
    sql = JOIN.format(form=names[others.index(form_col)])
    given = rows.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{output_col}`"))
    kinds = [(n, given.schema[c].dataType.simpleString()) for n, c in zip([*names, "o"], [*others, output_col])]
    out = given.mapInArrow(by_sql(sql, [*names, "o"]), ", ".join(f"{n} {k}" for n, k in kinds) + ", restored string")
    return out.toDF(*others, output_col, "restored")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: Pieces by places of code points in the text, not by lists of units; what is restored is the text itself.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS u,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, len(u) AS n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(list_sum(u[1:least(h1 % (len(u) + 1), h2 % (len(u) + 1))]), 0)::BIGINT AS a, coalesce(list_sum(u[1:greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))]), 0)::BIGINT AS b FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM f"""
