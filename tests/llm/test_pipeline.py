import hashlib
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry_points
import check
import corpus_pipeline
from newsloom.llm import decontaminate, pieces, quality_rules, queries, secrets, simhash
from newsloom.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
CONTRACT = {
    1: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    2: "doc_id held_out score predicted",
    3: "doc_id n_tokens ids_sha256 decoded_sha256",
    4: "doc_id n_words n_hit n_items items_sha256 contaminated",
    5: "doc_id held_out n_tokens n_known train_tokens base_score score",
    6: "page_id url text n_chars",
    7: "doc_id fingerprint component_id",
    8: "doc_id n_bytes n_removed n_spans kept_sha256",
    9: "doc_id n_assign n_access n_hex base_sha256 spans",
    10: "doc_id held_out score predicted",
    11: "word form root n n_near form_n",
    12: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    13: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}
LONGS = "n_words n_hit n_items n_tokens n_bytes n_removed n_spans n n_near form_n n_email n_card n_runs start period".split()


def test_every_operator_and_the_pipeline_are_registered():
    names = set(entry_points.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(CONTRACT)
    assert "pipeline" in names and set(queries.ORACLES) <= set(queries.QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_the_columns_of_its_contract(spark, name):
    rows = queries.QUERIES[name](spark, SMALL)
    wanted = CONTRACT[int(name[2:].split("_")[0])].split()
    assert set(wanted) <= set(rows.columns)
    assert all(kind == "bigint" for column, kind in rows.dtypes if column in LONGS)
    if "word" in wanted:  # one row for each word
        assert rows.count() == rows.select("word").distinct().count() > 1000
        return
    table = "pages" if "html" in name else "documents"
    assert rows.count() == read_table(spark, SMALL, table).count()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_its_statement(spark, name):
    good, text = check.compare(spark, SMALL, name, check.connect(SMALL))
    assert good, text


@needs_data
def test_pipeline_does_what_its_stages_do(spark):
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    docs = read_table(spark, SMALL, "documents")
    rules = quality_rules.fit(docs, read_table(spark, SMALL, "labels"))
    kept = {r.doc_id for r in quality_rules.judge(docs, rules).where("kept").collect()}
    good = docs.where(docs.doc_id.isin(list(kept)))
    first = {r.component_id for r in simhash.components_of(good).collect()}
    one = good.where(good.doc_id.isin(list(first)))
    judged = decontaminate.judge(one, read_table(spark, SMALL, "benchmark"))
    clean = {r.doc_id for r in judged.where("NOT contaminated").collect()}
    assert set(found) == clean and len(clean) < len(first) < len(kept) < docs.count()
    last = secrets.redact(one.where(one.doc_id.isin(list(clean)))).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    for row in last:
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        assert found[row.doc_id].n_tokens == len(ids)
        assert found[row.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, make_docs, odd_rows, tmp_path):
    make_docs(odd_rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = read_table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, str(tmp_path))
        assert dict(result.dtypes) == dict(docs.dtypes)
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
