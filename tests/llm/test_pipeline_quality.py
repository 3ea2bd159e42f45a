import corpus_pipeline as C
from pyspark.sql import functions as F


def test_what_the_classifier_rejects_goes(spark, sf_dir, monkeypatch):
    scores = {1: 0.1, 2: 0.35, 3: 0.45, 4: 0.5, 5: 0.9}
    docs = spark.createDataFrame([(i, "text", "en", "a", 4) for i in scores], "doc_id long, text string, lang string, source string, n_chars long")
    score = F.element_at(F.create_map(*(F.lit(x) for kv in scores.items() for x in kv)), F.col("doc_id").cast("int"))
    monkeypatch.setattr(C, "fit", lambda docs, labels: None)
    monkeypatch.setattr(C, "scored", lambda docs, model: docs.withColumn("score", score))
    assert sorted(r.doc_id for r in C.quality(spark, docs, sf_dir).collect()) == [4, 5]
