import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        counts.append(out.count())
        if name == "passage_dedup":
            assert out.where(F.length("text") != F.col("n_chars")).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        else:
            import public_tokenizers
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all(list(r.ids) == lib.encode(texts[r.doc_id] or "") for r in out.collect())
        docs = out
    assert counts[1] >= 0.98 * counts[0] and counts[1] >= counts[2] == counts[3] and counts[4] == counts[5]


def test_entry_lists_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_take_odd_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("own"))
    odd = [(None, None, None, None, None), (-1, None, "en", "s", 0), (-2, "", None, None, 0), (-3, " \n", "en", "s", 2), (-4, "日本語 😀", "en", None, 6), (-4, "日本語 😀", "en", None, 6), (-5, "x " * 5000, None, "s", 10000)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("own"))
    odd = odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    for now in (docs.where("doc_id < 60").unionByName(odd), docs.where("false")):
        some = not now.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF).cache()
            assert bool(out.count()) == some, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == now.columns, name
            if name == "language_id":
                assert out.where("text is null or trim(text) = ''").count() == 0
            if name == "near_dedup":
                assert out.where("doc_id = -4").count() <= 1
            now = out
