"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import numpy as np
import pytest

import corpus_pipeline
from footfall.llm import mixing, quality, secret_scan
from footfall.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same
from tests.llm.test_operators import _check_pieces, _classes

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(QUERIES[name], ORACLE_SQL[name], spark, FOLDER)


def test_pipeline_against_plain_python(spark):
    """Each stage once more over plain rows, from the stage's own fitted scores: filter, brute-force classes, redaction,
    copies, and every token in one place."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scores = quality.score(docs, quality.train(quality.labelled_texts(docs, labels))).toPandas()
    kept = scores[scores["score"] >= quality.THRESHOLD]
    one = stages["quality"](spark, docs, FOLDER).persist()
    assert one.columns == docs.columns and sorted(one.toPandas()["doc_id"]) == sorted(kept["doc_id"])
    comps, _ = _classes(list(zip(kept["doc_id"], kept["text"])))
    two = stages["near_dedup"](spark, one, FOLDER).persist()
    assert sorted(two.toPandas()["doc_id"]) == sorted(d for d, c in comps.items() if d == c)
    three = stages["secrets"](spark, two, FOLDER).persist()
    plain = {d: secret_scan.redacted(t, secret_scan.base_spans(t) + secret_scan.confirmed_spans(t)) for d, t in zip(kept["doc_id"], kept["text"])}
    assert all(plain[r["doc_id"]] == r["text"] and r["n_chars"] == len(r["text"]) for r in three.collect())
    four = stages["mixing"](spark, three, FOLDER).persist()
    assert four.columns == docs.columns and set(four.toPandas()["doc_id"]) == set(three.toPandas()["doc_id"])
    five = stages["packing"](spark, four.dropDuplicates(["doc_id"]), FOLDER).toPandas()
    _check_pieces(five, three.select("doc_id", "text").toPandas().itertuples(index=False))
    whole = corpus_pipeline.run(spark, FOLDER).toPandas()
    copies = four.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert whole.groupby("doc_id")["length"].sum().to_dict() == {d: copies[d] * n for d, n in five.groupby("doc_id")["doc_tokens"].first().items()}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert np.isclose(sum(mixing.TARGETS.values()), 1)
