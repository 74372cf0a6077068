"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import alignment, context_tree, fingerprint, language_id, lexical_search, line_dedup, near_dedup, packing, pii, quality_rules, secret_scan, segment_sampling, toxicity

OPERATORS = {
    "op1": quality_rules.quality_rules,
    "op2": packing.pack,
    "op3": secret_scan.secret_scan,
    "op4": line_dedup.line_dedup,
    "op5": language_id.language_id,
    "op6": context_tree.context_tree_score,
    "op7": segment_sampling.sample,
    "op8": fingerprint.edited_fingerprints,
    "op9": near_dedup.near_dedup,
    "op10": pii.pii,
    "op11": lambda docs: toxicity.toxicity(docs, docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("toxic"))),
    "op13": alignment.align,
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "key", "kept", "n", "node", "piece", "rank", "part", "length", "spans", "range", "copy", "found", "component", "removed_chunks", "is_first", "label", "held_out", "a", "b", "d", "t", "pos", "n_words", "first", "at", "text_length"]
PROSE = "the cat sat on the mat and then it went to the house of the man who was not there at all\nso it came back and slept on the mat by the fire of the old kitchen until the day was over and done"
ROWS = [
    (1, PROSE, "en", "s", 1),
    (2, PROSE, "en", "s", 1),
    (2, PROSE, "en", "s", 1),
    (3, None, "en", "s", None),
    (4, "", None, "s", 0),
    (5, " \n\t ", "fr", "s", 4),
    (6, "x" * 30_000, "xx", None, 1),
    (7, "word " * 30_000, "en", "s", 1),
    (None, "no id here, call +1 (988) 555-2485", None, None, None),
    (8, "日本語 😀 é \u0000 ünï", "de", "s", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    rows = OPERATORS[name](odd).collect()
    seen = [r.doc_id for r in rows]
    if name == "op2":
        assert set(seen) == {1, 2, 3, 4, 5, 6, 7, 8, None} and sum(i == 2 for i in seen) == 2
    elif name == "op7":
        assert set(seen) == {1, 2, 3, 4, 5, 6, 7, 8, None}
    else:
        assert sorted(seen, key=str) == sorted((r[0] for r in ROWS), key=str)
    drop = {"sequence_id", "offset", "edited_sha256", "edited_fingerprint", "near_edited", "near_next", "sample"}
    if name not in ("op7", "op8"):
        assert len({repr({k: v for k, v in r.asDict().items() if k not in drop}) for r in rows if r.doc_id == 2}) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_search_on_odd_rows(odd):
    """Documents as items and as documents: each with a term finds itself, or a copy, first."""
    got = lexical_search.lexical_search(odd, odd.withColumnRenamed("doc_id", "item_id")).where("rank = 1").collect()
    assert {r.item_id: r.doc_id for r in got} == {1: 1, 2: 1, 6: 6, 7: 7, 8: 8, None: None}


def test_stages_on_odd_rows(spark, odd):
    columns = odd.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns, name
            assert all(r[c] == "clash" for r in out.collect() for c in CLASH), name
        else:
            assert {r.doc_id for r in out.collect()} == {r[0] for r in ROWS}


def test_stages_on_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").collect() == []
