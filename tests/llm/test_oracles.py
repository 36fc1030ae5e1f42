"""The registered queries against their DuckDB SQL, and their columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from gradebook.llm import queries as Q  # noqa: E402
from oracle_check import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4_language_id": "doc_id held_out lang_pred score",
    "op5_byte_shards": "doc_id size text_crc32 law shard slot grown_shard", "op6_toxicity": "doc_id held_out score predicted",
    "op8_ann_curves": "query_id rank vec_id score", "op9_minhash_dedup": "doc_id n_shingles component_id kept",
    "op10_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op13_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_its_sql(spark, name):
    assert compare(spark, SF, [name], verbose=False)[name][0] == "OK"


def test_all_thirteen_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert Q.QUERIES[name](spark, SF).columns == COLUMNS[name].split()


def test_quality_rules_run_no_python(spark):
    plan = Q.QUERIES["op7_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
