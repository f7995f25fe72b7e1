"""Keys of rows that look alike, and numerals that look like letters."""

from gaugeflow.llm import language, packing
from gaugeflow.llm.common import row_key
from pyspark.sql import functions as F


def test_rows_that_are_spelt_alike_have_different_keys(spark):
    rows = [(None, "x"), ("x", None), ("", "x"), ("x", ""), (None, None), ("N", None),
            ("a|1:b", None), ("a", "b"), ("a|b", ""), ("a", "|b"), ("1:x", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    keys = df.select(row_key(1, F.col("a"), F.col("b")).alias("k")).distinct()
    assert keys.count() == len(rows)


def test_packing_tells_a_missing_id_from_a_missing_text(spark):
    docs = spark.createDataFrame([(None, "x"), ("x", None), ("a|b", "c d e"), ("a", "b|c d e f")],
                                 "doc_id string, text string")
    found = {(r.doc_id, r.text): r.pack.n_tokens for r in packing.pack(docs).collect()}
    assert found == {(None, "x"): 2, ("x", None): 1, ("a|b", "c d e"): 4, ("a", "b|c d e f"): 5}


def test_numerals_are_no_letters():
    assert language.letter_words("½ 123 ² Ⅷ ①") == []
    assert language.letter_words("x² Straße½ß Ab") == ["x", "straße", "ß", "ab"]
    assert language.letter_words("漢字 été") == ["漢字", "été"]
