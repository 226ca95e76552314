import os

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from civitext.llm.decontamination import contaminated
from civitext.llm.queries import QUERIES
from civitext.llm.simhash import simhash_components
from civitext.llm.toxicity import fit_toxicity, score_toxicity
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, by its name; `documents` is the first input."""
    out = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}
    docs = out["documents"]
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), name)
        out[name] = docs
    return out


def test_stages_keep_what_their_operators_decide(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rated = score_toxicity(kept["documents"], fit_toxicity(kept["documents"], labels))
    assert ids(kept["toxicity"]) == ids(rated.filter("predicted = 0").select("row.*"))
    groups = simhash_components(kept["toxicity"])
    assert ids(kept["near_dedup"]) == ids(groups.filter("doc_id = component_id"))
    leaks = contaminated(kept["near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(kept["decontamination"]) == sorted(set(ids(kept["near_dedup"])) - set(ids(leaks)))
    assert set(ids(kept["mixing"])) <= set(ids(kept["decontamination"]))
    assert ids(kept["sharding"]) == ids(kept["mixing"])


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(kept):
    names = kept["documents"].columns
    assert all(kept[n].columns == names for n, _ in corpus_pipeline.STAGES[:-1])
    assert kept["sharding"].columns == [*names, "shard", "slot"]


def test_pipeline_takes_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", None, 0), (3, "short", None, "a", 5), (3, "short", None, "a", 5)], docs.schema
    )
    docs.unionByName(odd).withColumn("key", docs["lang"]).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n in QUERIES))
def test_queries_match_their_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert compare(queries()[name](spark, SF).toPandas(), connect(SF).execute(oracle_sql()[name]).df()) == ""
