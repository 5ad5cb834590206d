import zlib

import numpy as np
import pytest

from sigstab.llm import quality, toxicity

from . import odd

CASES = [(toxicity, "toxic", 5, 0, 0.5), (quality, "quality", 4, 2, 0.7)]


def area(scores, labels):
    """Chance that a row of label 1 scores above one of label 0."""
    s, y = np.array(scores), np.array(labels)
    one, zero = s[y == 1][:, None], s[y == 0][None, :]
    return float(((one > zero) + 0.5 * (one == zero)).mean())


@pytest.mark.parametrize(("module", "label", "folds", "held", "cut"), CASES)
def test_held_out_rows(spark, module, label, folds, held, cut):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = module.score(docs, labels).collect()
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    seen = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert area([r["score"] for r in seen], [known[r["doc_id"]] for r in seen]) > 0.9


@pytest.mark.parametrize(("module", "label", "folds", "held", "cut"), CASES)
def test_held_out_labels_are_not_learned_from(spark, small, module, label, folds, held, cut):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.selectExpr("doc_id", *[f"case when crc32(cast(doc_id as string)) % {folds} = {held} then 1 - {label} else {label} end as {label}"])
    one, two = (sorted(map(tuple, module.score(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert np.allclose(one, two)


@pytest.mark.parametrize(("module", "label", "folds", "held", "cut"), CASES)
def test_odd_documents(spark, module, label, folds, held, cut):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(k, k % 2 if k != 4 else None) for k in range(16)], f"doc_id long, {label} int")
    rows = module.score(docs, labels).collect()
    assert len(rows) == len(odd.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)
    assert module.score(odd.empty(spark), labels).count() == 0
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r["score"] for r in module.score(docs, none).collect()} <= {0.0, 0.5}
