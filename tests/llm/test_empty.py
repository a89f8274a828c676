"""Empty tables, and tables of which nothing is left, through the operators and the pipeline; null ids, blank repeats, ties of near texts."""

import corpus_pipeline
from corpusloom.llm import brown_lm, packing, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert token_counts.count_tokens(none).count() == packing.pack_sequences(none).count() == brown_lm.score_documents(none).count() == 0


def pipeline(spark, path, rows, items=()):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert pipeline(spark, tmp_path, []) == []


def test_pipeline_of_null_ids_blanks_and_ties(spark, tmp_path):
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    text = " ".join(words)
    near = " ".join([*words[:50], "other", *words[51:]])
    rows = [(None, text), (7, near), (5, near), (9, " "), (9, " "), (10, None), (11, "few words only")]
    got = pipeline(spark, tmp_path, rows)
    # One class: the null id is its least; blanks, nulls and short texts are rejected first.
    assert {r.doc_id for r in got} == {None} and sum(r.length for r in got) == got[0].doc_tokens
