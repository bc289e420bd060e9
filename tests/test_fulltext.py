"""Stems of the published sample words; the index keeps names as they are and finds products by all lexemes of a query."""

import pytest
from pyspark.sql import functions as F

from lumenstock.functions.stemming import stem
from lumenstock.operators import fulltext, search

# Words and stems of the algorithm's published sample.
SAMPLE = """consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori
consolidating consolid consolingly consol conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc
knackeries knackeri knavish knavish kneaded knead knightly knight knitted knit knives knive knockers knocker skies sky news news dying die inning inning
generously generous communication communic proceeds proceed ties tie cries cri gas gas gaps gap kiwis kiwi cry cri by by say say hopping hop hoping hope
falling fall filing file fizzed fizz luxuriate luxuri goodness good relational relat conditional condit valency valenc digitizer digit operator oper
feudalism feudal decisiveness decis sensitivity sensit apology apolog triplicate triplic formative format formalize formal electricity electr
revival reviv adoption adopt rate rate controlled control roll roll cease ceas yellow yellow youth youth boyish boyish agreed agre feed feed a a 42 42""".split()


def test_stems(spark):
    rows = list(zip(SAMPLE[::2], SAMPLE[1::2]))
    df = spark.createDataFrame(rows, "word string, want string").withColumn("got", stem(F.col("word")))
    assert [tuple(r) for r in df.where("got <> want OR got IS NULL").collect()] == []
    assert spark.createDataFrame([(None,)], "word string").select(stem(F.col("word"))).first()[0] is None


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(1, "Running Walker", "RW-7", "The carrying unit", None), (2, "Walker", None, None, "It runs while carrying boxes"),
            (3, "the", "X9", "", "of the"), (4, None, None, None, None), (5, "walks", "RW-8", "walks and carries", "running")]
    return spark.createDataFrame(rows, "id int, name string, model_code string, summary string, description string")


def test_index_keeps_names_and_stems_texts(spark, shelf):
    got = {(r.lexeme, r.product_id, r.weight) for r in fulltext.stored_index(fulltext.field_texts(shelf)).collect()}
    assert ("running", 1, "A") in got and ("run", 1, "A") not in got and ("carri", 1, "B") in got and ("run", 2, "C") in got
    assert ("the", 3, "A") in got and not any(p == 4 for _, p, _ in got) and not any(w == "of" for w, _, _ in got)
    assert len(got) == len({(w, p) for w, p, _ in got}) and ("walk", 5, "B") in got and ("walks", 5, "A") in got


@pytest.mark.parametrize("q, ids", [
    ("carries", {1, 2, 5}), ("Carrying, RUNS!", {2, 5}), ("rw 7", {1}), ("walker", {1, 2}), ("the of", set()), ("", set()),
    ("walker unit", {1}), ("nowhere", set()), ("walking walks", {5}),
])
def test_match_needs_every_lexeme(spark, shelf, q, ids):
    index = fulltext.stored_index(fulltext.field_texts(shelf))
    assert {r.id for r in search.match_text(shelf, q, index).collect()} == ids
    assert {r.id for r in search.match_text(shelf, q).collect()} == ids


def test_descriptions_of_their_own_and_a_word_of_most_products(spark):
    products = spark.range(500).select(F.col("id").cast("int").alias("id"), F.lit("common").alias("name"))
    texts = spark.createDataFrame([(7, "Rarely said"), (8, None)], "product_id int, text string")
    index = fulltext.stored_index(fulltext.field_texts(products, texts))
    assert fulltext.matching_products(index, "common").count() == 500
    assert [r.id for r in fulltext.matching_products(index, "common scarce").collect()] == []
    assert [r.id for r in fulltext.matching_products(index, "common rarely").collect()] == [7]


def test_entries_of_the_index_move_once(shelf, monkeypatch):
    """The words meet their stems and fold without a move of their own; of several fields the weightiest counts."""
    plans, store = {}, fulltext.materialize
    monkeypatch.setattr(fulltext, "materialize", lambda df, label: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), store(df, label))[1])
    index = fulltext.stored_index(fulltext.field_texts(shelf))
    assert plans["text-index"].count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plans["text-index"]
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, fulltext.postings(fulltext.field_texts(shelf)).collect()))
    assert {r.weight for r in index.where("product_id = 2 AND lexeme IN ('walker', 'box', 'run')").collect()} == {"A", "C"}
