"""The hybrid search finds what only the words or only the vectors find."""

from silverloom.plans import search


def test_documents_that_match_by_words_only(spark, tmp_path):
    docs = [(i, "en", "wiki", "zebra ledger" if i in (0, 15) else f"plain words {i}") for i in range(16)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    near = [(v, 1, [1.0, v / 1000]) for v in range(30)] + [(v, 2, [-1.0, 0.5]) for v in (30, 31)]
    spark.createDataFrame(near, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    fused = {r.file_path for r in search.rrf_fuse(spark, str(tmp_path)).collect()}
    assert "/src/wiki/doc_15.txt" in fused and "/src/wiki/doc_1.txt" in fused
    assert "/src/wiki/doc_15.txt" in {r.file_path for r in search.hybrid_boosted_top10(spark, str(tmp_path)).collect()}
