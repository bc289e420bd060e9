"""Full-text index of products: which lexeme stands in which product, and in how weighty a field.

Names and model codes keep their words as they are; summaries and descriptions lose stop words and are stemmed, and so
is a query. A product matches when it holds every lexeme of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stage import materialize
from ..functions.stemming import stem

# Weight of each field, and the fields read as English.
WEIGHTS = {"name": "A", "model_code": "A", "summary": "B", "description": "C"}
ENGLISH = ["summary", "description"]
PLACES = sorted(set(WEIGHTS.values()))


def field_texts(products: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """(product_id, field, text) of the fields that `products` has, and of descriptions kept in a table of their own."""
    have = [f for f in WEIGHTS if f in products.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in have])).alias("f")
    rows = products.select(F.col("id").alias("product_id"), pairs).select("product_id", "f.*")
    if descriptions is None:
        return rows
    return rows.unionByName(descriptions.select("product_id", F.lit("description").alias("field"), "text"))


def _lexemes(texts: DataFrame) -> DataFrame:
    """(lexeme, product_id, place of the field's weight); a product holds a lexeme once for each of its texts at most.

    Words are made distinct per text and stored; every distinct English word is stemmed once. The stems are stored too, so
    that a vocabulary small enough to be sent to the tasks spares the words a move.
    """
    parts = F.array_distinct(F.split(F.lower(F.col("text")), "[^a-z0-9]+"))
    words = texts.where("text IS NOT NULL").select("product_id", "field", F.explode(parts).alias("word")).where("word <> ''")
    english = F.col("field").isin(ENGLISH)
    words = materialize(words.where(~english | ~F.col("word").isin(text.STOP_WORDS)), "text-words")
    stems = materialize(words.where(english).select("word").distinct().select("word", stem(F.col("word")).alias("lexeme")), "text-stems")
    place = F.create_map(*[F.lit(x) for f, w in WEIGHTS.items() for x in (f, PLACES.index(w))])[F.col("field")].alias("place")
    lexemes = words.where(english).join(stems, "word").select("lexeme", "product_id", place)
    return lexemes.unionByName(words.where(~english).select(F.col("word").alias("lexeme"), "product_id", place))


def _weight(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in PLACES]), place + 1).alias("weight")


def postings(texts: DataFrame) -> DataFrame:
    """(lexeme, product_id, weight), once each with the highest weight."""
    return _lexemes(texts).groupBy("lexeme", "product_id").agg(_weight(F.min("place")))


def stored_index(texts: DataFrame) -> DataFrame:
    """The postings, written in lexeme order so that a look-up by lexeme skips most of the files.

    Ranges are cut by (lexeme, product), so the list of a word that most products hold spans many files. Entries move once;
    the order they are written in also brings the few of one lexeme and product together.
    """
    first = F.row_number().over(W.partitionBy("lexeme", "product_id").orderBy("place"))
    rows = _lexemes(texts).repartitionByRange("lexeme", "product_id").withColumn("_nth", first).where("_nth = 1")
    return materialize(rows.sortWithinPartitions("lexeme", "product_id").select("lexeme", "product_id", _weight(F.col("place"))), "text-index")


def query_lexemes(index: DataFrame, q: str) -> list[str]:
    """Stems of the words of a query, without stop words; as many as the query has words."""
    asked = index.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array_distinct(text.words(F.lit(q)))).alias("word"))
    asked = asked.where(~F.col("word").isin(text.STOP_WORDS)).select(stem(F.col("word")).alias("lexeme"))
    return sorted({r["lexeme"] for r in asked.collect()})


def matching_products(index: DataFrame, q: str) -> DataFrame:
    """(id) of products that hold every lexeme of the query: its posting lists intersected. None for a query of stop words."""
    wanted = query_lexemes(index, q)
    if not wanted:
        return index.select(F.col("product_id").alias("id")).where(F.lit(False))
    found = index.where(F.col("lexeme").isin(wanted)).groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("held"))
    return found.where(F.col("held") == len(wanted)).select("id")
