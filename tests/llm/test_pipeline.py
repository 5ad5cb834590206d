"""The pipeline against the same stages in plain Python, stage by stage, each on what the stage before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from sigstab.llm import mixing, packing, pii, rules, simhash_tables

from . import odd
from .test_pii import base
from .test_rules import measured
from .test_simhash_tables import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stages(spark, docs, tmp_path):
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out.append(spark.read.parquet(f"{tmp_path}/{k}"))
    return out


def test_stages_on_a_whole_table(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    _, good, single, clean, mixed, packed = stages(spark, docs, tmp_path)
    assert all(x.columns == docs.columns for x in (good, single, clean, mixed))

    standard = {r["doc_id"] for r in rules.verdicts(docs).collect() if r["kept"]}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert kept.keys() == standard and all(measured(t)[0] >= 50 for t in kept.values())
    assert all(kept[i] == rows[i] for i in kept)

    ids = {r["doc_id"] for r in single.collect()}
    assert ids == {c for *_, c in components(list(kept.items()))}

    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts.keys() == ids
    assert all((texts[i] == kept[i]) or len(pii.KINDS) and "<" in texts[i] for i in ids)
    assert all(not base(t) for t in texts.values())

    taken = {r["doc_id"]: r["taken"] for r in mixing.decide(clean).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == {i: n for i, n in taken.items() if n}

    words = Counter()
    for r in packed.collect():
        words[r["doc_id"]] += r["n_words"]
    assert words == got
    fill = defaultdict(int)
    for r in packed.collect():
        fill[r["bin_id"]] += r["n_words"]
    assert max(fill.values()) <= packing.CAPACITY


def test_run_gives_the_last_stage(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "bin_id", "n_words", "text"} <= set(out.columns) and out.count() > 0


def test_odd_documents_and_an_empty_table(spark, tmp_path):
    for name, docs in (("odd", odd.documents(spark)), ("empty", odd.empty(spark))):
        out = stages(spark, docs, tmp_path / name)
        ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in out]
        assert all(later <= earlier for earlier, later in zip(ids, ids[1:], strict=False))
        assert name == "odd" or all(x.count() == 0 for x in out)
        assert all(x.columns == docs.columns for x in out[:-1])
        assert simhash_tables.deduplicate(out[1]).count() == out[2].count()
