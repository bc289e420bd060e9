"""The stages one by one and together."""

import corpus_pipeline
from lumenstock.llm import quality, toxicity
from lumenstock.llm.exact_dedup import exact_duplicates
from lumenstock.llm.ngram_join import links_and_components

from .support import no_documents, odd_documents


def test_stages_keep_columns_and_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        before, after = docs.count(), out.count()
        assert 0 < after <= before
        if name == "exact_dedup":
            assert out.select("text").distinct().count() == after == exact_duplicates(docs).where("kept").count()
        if name == "near_dedup":
            left = links_and_components(out, words=5, percent=80)
            assert left.select("component_id").distinct().count() == left.count() == after
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert packed.count() > 0


REPEATS = [
    (1, "same text here for both of them", "en"), (2, "same text here for both of them", "en"), (2, "same text here for both of them", "fr"),
    (3, "one id with two texts", "en"), (3, "another text of that id", "en"), (4, "one id with two texts", "en"),
    (5, None, None), (6, "", "en"), (None, "no id", "en"),
    (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z end", "en"),
]


def rows(df):
    return sorted(((r.doc_id, r.text or "", r.lang) for r in df.collect()), key=str)


def test_which_rows_stay(spark, sf_dir):
    """Of equal texts exactly one row, though ids, texts and whole rows repeat; of near copies the smallest id."""
    docs = spark.createDataFrame(REPEATS + REPEATS, "doc_id long, text string, lang string").repartition(3)
    once = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    assert rows(once) == sorted([
        (2, "same text here for both of them", "en"), (3, "another text of that id", "en"), (4, "one id with two texts", "en"), (6, "", "en"),
        (7, REPEATS[9][1], "en"), (8, REPEATS[10][1], "en")], key=str)
    near = rows(corpus_pipeline.drop_near_copies(spark, docs, sf_dir))
    assert (7, REPEATS[9][1], "en") in near and not any(r[0] == 8 for r in near) and len(near) == len(set(near))


def test_filters_judge_rows_by_their_own_text(spark, sf_dir):
    """A toxic row goes and a clean row stays though both have one id; the columns of a row stay together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs, labels)
    worst = docs.join(scored.orderBy("score", ascending=False).limit(1).select("doc_id"), "doc_id").first()
    best = docs.join(scored.where("score < 0.1").orderBy("doc_id").limit(1).select("doc_id"), "doc_id").first()
    both = docs.limit(0).unionByName(spark.createDataFrame([(900_000, worst.text, "xx", "s", 1), (900_000, best.text, "yy", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = toxicity.clean_rows(both, toxicity.fit(docs, labels)).collect()
    assert [(r.lang, r.text, r.n_chars) for r in kept] == [("yy", best.text, 2)]
    stage = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert rows(stage) == rows(docs.join(scored.where("predicted = 0").select("doc_id"), "doc_id", "left_semi"))
    good = quality.quality(docs, labels).where("predicted = 1").select("doc_id")
    assert rows(corpus_pipeline.keep_quality(spark, docs, sf_dir)) == rows(docs.join(good, "doc_id", "left_semi"))


def test_stages_take_odd_tables(spark, sf_dir):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).count()
