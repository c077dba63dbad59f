"""Every registered query against its SQL twin at the smallest scale."""

from __future__ import annotations

import importlib.util

import pytest

import __spark_entry__ as contract
from papyra.plans import load_all
from tests import oracle

SF = "0.001"
QUERIES = load_all()
HEAVY = {  # fits, checked for their quality in test_models
    "f1_text_classifier", "f4_tabular_classifiers", "f5b_topic_distribution", "f7_sequence_tag_training",
    "f14_batch_parse", "f15_diacritic_restoration", "b11_vector_text",
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in HEAVY])
def test_query(spark, con, name):
    outcome = oracle.check(spark, con, QUERIES[name], SF)
    assert outcome.startswith(("OK", "ROWS")), outcome


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    flagship = contract.entry(spark)
    assert flagship.columns == ["doc_id", "text"]
    assert flagship.count() > 0
    numbered = [n for n in contract.queries() if n == "pipeline" or n.startswith("op")]
    assert bool(numbered) == (importlib.util.find_spec("papyra.llm") is not None)
    assert len(set(n.split("_")[0] for n in numbered)) == len(numbered)


@pytest.mark.parametrize(
    "name", ["c6_paragraph_dedup", "c8_curate_crawl", "e13_index_sequence", "e27_sliding_id_windows", "h3_act_history",
             "i2_rolling_samples", "i3_dedup_impute", "i7_extreme_flag", "j2_and_search"],
)
def test_same_result_for_other_partition_counts(spark, name):
    def result(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            df = QUERIES[name].run(spark, f"{oracle.DATA}/sf{SF}")
            return oracle.canonical(df.columns, df.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert result("1") == result("37")
