"""Analyses of whole texts: nothing of a text is shuffled."""

import pytest

from mediagrain import plans
from mediagrain.operators import lyrics


@pytest.mark.parametrize("name", ["l11_vocabulary", "l11b_frequent_words", "l12_process_lyrics"])
def test_texts_and_words_are_not_shuffled(spark, name):
    """a row for each word or line went through shuffles before; the words are counted once."""
    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_words_of_odd_texts(spark):
    texts = [(1, None), (2, " \t\n"), (3, "The the, THE"), (4, "alpha beta beta Verylong! (verylong) otherwise\x0bagainst éééééééé"), (5, "b a b a c")]
    counts = lyrics.word_counts(spark.createDataFrame(texts, "id int, t string"), "id", "t")
    assert {r.id: (r.total, r.different, r.rare) for r in lyrics.vocabulary(counts, "id").collect()} == {4: (8, 6, ["otherwise", "against", "éééééééé"]), 5: (5, 3, [])}
    assert [(r.word, r.n, r["rank"]) for r in lyrics.frequent_words(counts, "id", 2).filter("id = 5").collect()] == [("b", 2, 1), ("a", 2, 2)]
