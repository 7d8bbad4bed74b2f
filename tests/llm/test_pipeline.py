"""Each stage of the pipeline against brute force on what the stage before it kept."""

from collections import Counter

import public_tokenizers
import pytest
from conftest import SF_MID
from pyspark.sql import functions as F
from test_texts import WORD, base, classes, plain_spans
from test_tokens import check_sequences, library

import corpus_pipeline
from scorewatch.llm import privacy


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d, out = str(tmp_path_factory.mktemp("stages")), [spark.read.parquet(f"{SF_MID}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF_MID).write.parquet(f"{d}/{k}")
        out.append(spark.read.parquet(f"{d}/{k}"))
    return out


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_stage_rejects_base_failures(stages):
    before, kept = {r.doc_id: r.text for r in stages[0].collect()}, {r.doc_id for r in stages[1].collect()}
    failed = {i for i, t in before.items() if base(t)[-1]}
    assert not kept & failed and len(kept) > 0.8 * (len(before) - len(failed))


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {c for _, _, c in classes(rows)}


def test_personal_data_is_replaced(stages):
    before, after = {r.doc_id: r for r in stages[2].collect()}, {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        t = after[i].text
        assert not plain_spans(t) and after[i].n_chars == len(t)
        if not plain_spans(r.text):
            assert t == r.text
    labels = sum(r.text.count(x) for r in after.values() for x in privacy.LABELS[:4])
    assert labels >= sum(bool(plain_spans(r.text)) for r in before.values())


def test_packing_stage(stages):
    rows = {r.doc_id: r.text for r in stages[3].collect()}
    n = {i: len(x) + 1 for i, x in zip(rows, library("byte_bpe_50k.json", list(rows.values())), strict=True)}
    got = stages[4].collect()
    per = Counter()
    for r in got:
        per[r.doc_id] += r.length
    assert per == Counter(n)
    check_sequences(got, sum(n.values()))


@pytest.mark.parametrize("where", ["edge", "empty", "clash"])
def test_stages_take_any_rows(spark, edge_dir, empty_dir, tmp_path, where):
    """Nulls in all columns, repeated rows and ids, odd texts, no rows, and columns named like those of the operators."""
    d = empty_dir if where == "empty" else edge_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    if where == "clash":
        more = ("row", "kept", "n", "key", "tkey", "copy", "component", "base", "spans", "rid", "piece", "start", "length", "sequence_id", "offset", "score", "trusted")
        nothing = spark.createDataFrame([(None, None)] * 2, "doc_id long, text string").select("*", *[F.lit(None).cast("string").alias(c) for c in more])
        docs = docs.select("doc_id", "text", *[F.lit(f"of {c}").alias(c) for c in more]).unionByName(nothing)
    columns, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, d).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert after.columns == columns
            rest = [c for c in columns if c not in ("text", "n_chars")]
            assert after.select(*rest).exceptAll(before.select(*rest)).isEmpty()
        before = after
    if where == "empty":
        assert before.isEmpty()
    else:
        kept = spark.read.parquet(f"{tmp_path}/2")
        assert 0 < kept.count() and before.select("doc_id").distinct().exceptAll(kept.select("doc_id").distinct()).isEmpty()
        assert before.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n != m or n > 2048").isEmpty()


def test_run_gives_the_last_stage(spark, stages):
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF_MID).collect())
    assert got == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4].collect())
    assert corpus_pipeline.ORACLE_SQL is None and WORD
