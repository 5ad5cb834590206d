import re
from collections import Counter

from sigstab.llm import rules
from sigstab.llm.common import checkpointed

from . import odd


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    counts = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if counts[x] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def expected(rows):
    out = []
    for i, text in rows:
        m = measured(text)
        out.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    return sorted(out, key=repr)


def test_measurements_of_odd_documents(spark):
    got = rules.verdicts(odd.documents(spark)).collect()
    assert sorted([tuple(r)[:7] for r in got], key=repr) == expected([r[:2] for r in odd.rows()])
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["kept"] == (r["fail_bits"] == 0) for r in got)


def test_measurements_of_a_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = rules.verdicts(docs)
    assert sorted([tuple(r)[:7] for r in got.collect()], key=repr) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_keep_returns_rows_untouched(spark):
    docs = odd.documents(spark)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    bits = {r["doc_id"]: r["fail_bits"] for r in rules.ledger(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, b in bits.items() if not b)


def test_policies_and_ablations_come_from_the_stored_bits(spark, small):
    stored = checkpointed(rules.ledger(spark.read.parquet(f"{small}/documents.parquet"))).select("doc_id", "fail_bits")
    bits = [r["fail_bits"] for r in stored.collect()]
    got = {(r["policy"], r["rule"]): (r["fails"], r["rejects"], r["only_this"]) for r in rules.ablations(stored).collect()}
    for p in rules.POLICIES:
        for rule in p.rules:
            b = rules.BIT[rule]
            assert got[p.name, rule] == (sum(x & b != 0 for x in bits), sum(x & p.mask != 0 for x in bits), sum(x & p.mask == b for x in bits))
        assert rules.apply_policy(stored, p).where("kept").count() == sum(x & p.mask == 0 for x in bits)


def test_empty_table(spark):
    assert rules.verdicts(odd.empty(spark)).count() == 0
    assert rules.ablations(checkpointed(rules.ledger(odd.empty(spark)))).count() == 0
