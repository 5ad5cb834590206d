"""Stages leave columns of any name as they are, those that the operators use inside among them."""

import pytest

from sigstab.llm import mixing, pii, rules, simhash, simhash_tables

from . import odd

NAMES = (
    "size source_size target place block draws d rows _before h shard _shard _place quota words take number copy cut row id "
    "mark _mark _n i m k fp root component_id least_id fingerprint _s spans base_spans _new t x s text_1 _text kept failed node value "
    "h1 h2 m1 m2 no_id same sig cls band key many least"
).split()


def marked(spark, small):
    docs = odd.documents(spark).drop("size", "n_words", "taken").unionByName(spark.read.parquet(f"{small}/documents.parquet").where("doc_id >= 100"))
    rows = [(*r, *(f"{n}:{r['doc_id']}" for n in NAMES)) for r in docs.collect()]
    return spark.createDataFrame(rows, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in docs.schema)}, {', '.join(f'`{n}` string' for n in NAMES)}")


@pytest.mark.parametrize("stage", [rules.keep, simhash.deduplicate, simhash_tables.deduplicate, pii.redact, mixing.mix])
def test_a_stage_keeps_columns_of_any_name(spark, small, stage):
    docs = marked(spark, small)
    out = stage(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in NAMES)
