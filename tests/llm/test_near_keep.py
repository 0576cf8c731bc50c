"""Near copies go by component, not by doc_id."""

from forecastlab.llm import near_copies, simhash

from .test_corpus_operators import docs_of


def test_texts_that_share_a_doc_id_stay_if_no_near_copy_does(spark):
    one, other, near = "a b c d e f g", "one two three four five six", "A b c d e f g"
    rows = [(1, one, "s"), (1, other, "s"), (0, near, "s"), (2, other + " ", "s")]
    for drop in (simhash.drop_near_copies, near_copies.drop_near_copies):
        assert sorted((r["doc_id"], r["text"]) for r in drop(docs_of(spark, rows)).collect()) == [(0, near), (1, other)]
