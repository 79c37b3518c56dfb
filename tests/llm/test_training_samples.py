from pyspark.sql import functions as F

from tidewater.llm import language_id as L


def test_long_texts_do_not_thin_a_language_out(spark):
    long = F.repeat(F.lit("sehr langer Text "), L.MAX_TRAIN_DOC_BYTES // 8)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 580, "de").otherwise("fr").alias("lang"), F.when((F.col("id") % 20 > 0) | (F.col("id") >= 580), long).otherwise(F.concat(F.lit("kurz "), F.col("id").cast("string"))).alias("text"))
    got = L.sample(docs, 10)
    short = docs.where("lang = 'de' and octet_length(text) < 100").where(~L.held_out(F.col("doc_id"))).count()
    assert short >= 10 and len(got["de"]) == 10 and all(len(t) < 100 for t in got["de"])
    assert len(got["fr"]) == 10 and all(len(t) <= L.MAX_TRAIN_DOC_BYTES for t in got["fr"])
