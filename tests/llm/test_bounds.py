"""What bounds training, and columns whose names an operator would like to use."""

from cipherscape.llm import mixing, quality


def test_training_holds_so_many_bytes(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} " * 20 + f"x{k}") for k in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    whole, less = (quality.trained(docs, labels, "quality", held=held) for held in (quality.TRAIN_BYTES, 2000))
    assert 0 < len(less.places) < len(whole.places)
    assert len(quality.trained(docs, labels, "quality", held=1).places) == 0


def test_shapes_of_whole_words():
    assert quality.shape("-" * 20 + "a") != quality.shape("-" * 20 + "0")


def test_mixing_beside_any_columns(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 5 + 1), f"s{k % 3}", "mine", k, "2", "row", 7) for k in range(90)], "doc_id long, text string, source string, __row string, row long, times string, Copy string, row_ int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r["__row"] == "mine" and r["row"] == r.doc_id and r.times == "2" and r.Copy == "row" and r.row_ == 7 for r in rows)
