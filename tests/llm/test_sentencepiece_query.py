"""The SentencePiece query gives the library's counts whether units are frequent or rare."""

from sparkquill.llm import sentencepiece_lattice as S

ROWS = [(1, "a b"), (2, None), (3, ""), (4, "Zq. xé\n😀, a b. " * 3), (5, "x" * 200 + " a"), (6, " \n "), (None, "hello a"), (None, None), (None, "hello a"), (1, "a b"), (1, "a b"), (7, "qz q a b")]


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    import public_tokenizers
    import sentencepiece

    spark.createDataFrame(ROWS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(str((k, len(lib.encode(t or "")))) for k, t in ROWS)
    tables = []
    for bound, second in ((400_000, 400_000), (3, 2), (0, 400_000), (0, 0)):
        monkeypatch.setattr(S, "FREQUENT", bound)
        monkeypatch.setattr(S, "SECOND", second)
        rows = S.op7_sentencepiece(spark, str(tmp_path)).collect()
        assert sorted(str((r["doc_id"], r["n_pieces"])) for r in rows) == want
        assert all(r["round_trip"] for r in rows)
        tables.append(sorted(str(tuple(r)) for r in rows))
    assert all(x == tables[0] for x in tables) and len(tables[0]) == len(ROWS)
    equal = [r for r in rows if r["doc_id"] == 1]
    assert len(equal) == 3 and len(set(equal)) == 1 and equal[0]["n_units"] > 0
    assert all(r["ids_hash"] == r["n_units"] == 0 for r in rows if r["doc_id"] in (2, 3))
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert S.op7_sentencepiece(spark, f"{tmp_path}/none").count() == 0
