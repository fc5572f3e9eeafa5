"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names in every operator."""

import pytest
from fixtures import ROWS, documents, items, vectors
from pyspark.sql import functions as F

import corpus_pipeline
from lotwise.llm import (
    deobfuscation, digest_merge, direct_codes, grammar_runs, kd_shards, language_codes, lexical_blocks, piece_codec,
    pivot_simhash, projection_forest, secret_crf, suffix_automaton, url_templates,
)
from lotwise.llm.queries import tokenizer_path

OPERATORS = {
    "languages": lambda d: language_codes.predict_languages(d, language_codes.train_language_codes(d)),
    "contamination": lambda d: suffix_automaton.find_contamination(d, items(d.sparkSession)),
    "secrets": lambda d: secret_crf.scan_secrets(d, secret_crf.train_secret_field(d)),
    "pieces": lambda d: piece_codec.checked_pieces(d, tokenizer_path("piece_bpe_32k.model")),
    "personal": deobfuscation.find_personal_data,
    "shards": kd_shards.kd_shards,
    "codes": lambda d: direct_codes.direct_codes(d, tokenizer_path("byte_bpe_50k.json")),
    "copies": pivot_simhash.near_duplicates,
    "equal texts": digest_merge.exact_copies,
    "runs": grammar_runs.find_runs,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(spark, name):
    found = OPERATORS[name](documents(spark)).select("doc_id").collect()
    key = lambda x: (x is not None, x or 0)
    assert sorted((r[0] for r in found), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).collect() == []


def test_empty_items(spark):
    rows = suffix_automaton.find_contamination(documents(spark), items(spark, [])).collect()
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in rows)


def test_empty_vectors_and_pages(spark):
    assert projection_forest.nearest(vectors(spark, []), F.col("id") % 50 == 0).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, host string, purity int")
    assert url_templates.judge_urls(pages).collect() == []


def test_search_of_awkward_rows(spark):
    search = lexical_blocks.lexical_search
    found = search(documents(spark), items(spark)).collect()
    assert {(r["item_id"], r["rank"]) for r in found} == {(0, 1), (0, 2), (0, 3), (3, 1), (3, 2), (3, 3), (None, 1)}
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["item_id"] == 3] == [1, 2, 2]
    assert search(documents(spark, []), items(spark)).collect() == []
    assert search(documents(spark), items(spark, [])).collect() == []


def test_pipeline_stages_keep_columns(spark, tmp_path):
    items(spark, [(0, "no such passage"), (1, None)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.where("not same").count() == 0
        if rows:
            ids = {r["doc_id"] for r in last.collect()}
            assert 1 in ids and 2 not in ids and not ids & {4, 5, 6, 7}


def test_pipeline_stages_by_hand(spark, tmp_path):
    """What each stage decides, row by row."""
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [
        (1, passage, "en", "a"), (2, "before " * 400 + passage, "en", "a"), (3, "password=abcdef1234 stays", "en", "a"),
    ])
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in clean.collect()} == {2, 3}
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.redact_secrets(spark, docs, "").collect()}
    assert text[3] == ("[SECRET] stays", 14) and text[1][0] == passage
