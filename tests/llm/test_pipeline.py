import corpus_pipeline
from pyspark.sql import functions as F

from noticelake.llm.common import saved

from ..oracle import DATA


def test_stages_on_edge_rows(spark, tmp_path):
    good = "Er und onen theat whing ly thand heat ion. Ander the thing on oner."
    texts = [None, "", "123", good, good, good + " zwei", "Another text of some words.\nA line that two share\n", "Third text stands here.\nA line that two share"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "Without an id, but with words.", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {None, 3, 4, 5, 6, 7}  # 4 lost its one line to 3, and is the one document without words that stays
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = saved(stage(spark, empty, DATA), name)
        assert empty.count() == 0


def test_run(spark):
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    whole = packed.groupby("doc_id").agg(tokens=("length", "sum"), doc=("doc_tokens", "first"))
    assert (whole.tokens == whole.doc).all() and len(whole) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "packing"]
