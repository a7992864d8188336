"""The queries of the subpackage, against their SQL or plain versions, on the smallest tables."""

import pytest
from cases import ODD, clashing, documents
from oracle import connect, differences
from test_near_copies import brute_kept
from test_search_and_links import brute_components, brute_print

import __spark_entry__ as entry
import corpus_pipeline
from palaver.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_covers_its_table(spark, folder, name):
    rows = QUERIES[name](spark, folder).count()
    table = "pages" if name.startswith("op4") else "documents"
    whole = spark.read.parquet(f"{folder}/{table}.parquet").count()
    assert rows == whole or name.startswith(("op2", "op7")) and rows > 0


def test_simhash_query_equals_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    label = brute_components(sorted(set(prints.values())), 2)
    least = {}
    for i, p in prints.items():
        least[label[p]] = min(i, least.get(label[p], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, folder).collect()}
    assert got == {i: (f"{p:016x}", least[label[p]]) for i, p in prints.items()}


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids, last = docs.columns, {r["doc_id"] for r in docs.collect()}, None
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(kept[name]) <= ids
        ids = set(kept[name])
    clean = set(kept["toxicity"])
    largest = {}
    for i in clean:
        largest[texts[i]] = max(i, largest.get(texts[i], i))
    assert sorted(kept["exact_dedup"]) == sorted(largest.values())
    assert sorted(kept["simhash"]) == brute_kept([(i, texts[i]) for i in kept["exact_dedup"]])
    assert set(kept["packing"]) == set(kept["mixing"])
    assert "pipeline" in entry.queries()


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", clashing(documents(spark, ODD))), ("empty", documents(spark, ODD).limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        none.write.parquet(str(tmp_path / name / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    # exact copies leave their largest id, near copies their smallest: 2 of the twins, 4 of the blanks, 6 of the long texts
    assert {p["doc_id"] for p in pieces} <= {2, 4, 6, 8, 9, None} and {p["doc_id"] for p in pieces} >= {2, 6, 8}
    assert all(0 < p["length"] <= 4096 for p in pieces)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
