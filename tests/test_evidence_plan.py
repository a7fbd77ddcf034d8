"""Term evidence sends a few queries' terms to the documents' terms, not a frequent term's documents to one task."""

from recollect.operators import prompts


def test_documents_of_a_term_are_not_gathered(spark):
    held = spark.range(2_000_000).selectExpr("id", "concat('t', id % 3) AS term")
    asked = spark.createDataFrame([(1, "t1"), (1, "none")], "query_id long, term string")
    found = prompts.term_evidence(asked, held, prompts.term_weights(held, 2_000_000), 0.5)
    assert "SortMergeJoin [term" not in found._jdf.queryExecution().executedPlan().toString()
