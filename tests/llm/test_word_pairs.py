"""Candidate pairs of words are joined and measured once."""

from leadmill.llm import spelling


def test_pairs_of_words_are_measured_once(spark):
    """Before, the pairs and their reverse each joined and measured all candidates."""
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 26)
    words = spark.createDataFrame([("letter",), ("lettar",), ("later",), ("other",)], "word string")
    pairs = spelling.near_pairs(words)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1
    assert {(r.a, r.b) for r in pairs.collect()} == {("letter", "lettar"), ("lettar", "letter")}
