from pyspark.sql import functions as F

from loomtext.operators import features as ft


def test_a_words_vector_is_sent_to_blocks_and_not_to_texts(spark, monkeypatch):
    """Repeated ids share their words; null ids, null texts and unknown words give zeros; a word may have two vectors."""
    monkeypatch.setattr(ft, "WORDS_A_BLOCK", 3)
    texts = [(1, ["a", "b", "a"]), (1, ["b"]), (2, None), (3, ["x", None]), (None, ["a"]), (4, ["c"]), *[(k, ["b", "b"]) for k in range(5, 25)]]
    df = spark.createDataFrame(texts, "id long, words array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [3.0, 0.0]), ("c", [0.0, 4.0]), ("b2", None)], "word string, vec array<float>")
    found = ft.pooled_vectors(df, vectors, id_col="id", words=F.col("words"), dim=2)
    got = sorted((str(r.id), [round(x, 6) for x in r.vector]) for r in found.collect())
    half = round(0.5**0.5, 6)
    want = [("1", [half, half])] * 2 + [("2", [0.0, 0.0]), ("3", [0.0, 0.0]), ("None", [0.0, 0.0]), ("4", [0.6, 0.8])] + [(str(k), [0.0, 1.0]) for k in range(5, 25)]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroupsInArrow" in plan
