import hashlib
import re
import time

from pyspark.sql import functions as F

from sigstab.llm import pii

from . import odd

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    return [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(kind, m[0])]


def check(docs):
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    got = sorted((r for r in pii.digests(docs).collect()), key=lambda r: repr((r["doc_id"],)))
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(base(t))
    for r in got:
        found = [b for b in want[r["doc_id"]] if hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest() == r["base_sha256"]]
        assert found, r["doc_id"]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in found[0]) for k in PATTERNS]
        spans = set(filter(None, r["spans"].split(",")))
        assert {f"{k}:{s}:{e}" for k, s, e in found[0]} <= spans
    assert len(got) == len(texts)


def test_base_spans_of_a_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_documents(spark):
    check(odd.documents(spark))
    assert pii.digests(odd.empty(spark)).count() == 0


def test_hard_texts(spark):
    texts = [
        "a@b.c.d. x@y a@b@c.de ..@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4 1 1 1", "+1 (2) 3.4-5 6789 0 +49 30 ++12345678901",
        "9" * 5000, "+" + "1 " * 3000 + "1", "a." * 4000 + "@b", "1." * 5000, "😀 a@b.cd 😀 1.2.3.4",
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_added_spans(spark):
    texts = [
        'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b was fine", "please call (030) 555-0199 today", "date 2024-05-17 and page 12",
        "write to jane.doe [at] mail [dot] org", "nothing personal in this plain sentence at all",
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].startswith("secret:") and got[2].startswith("phone:") and got[4].startswith("email:")
    assert got[3] == "" and got[5] == ""


def test_redaction(spark):
    docs = odd.documents(spark)
    done = pii.redact(docs)
    assert done.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in done.collect()}
    assert by[11] == "call <PHONE> or <EMAIL> now"
    assert by[0] is None and by[1] == "" and by[8] == odd.LONG
    rows = [(i, t) for i, t in by.items()]
    again = pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0 for r in again)


def test_the_main_path_has_no_python(spark, small):
    plan = pii.digests(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_a_number_beside_others_is_found(spark):
    texts = [
        "Des +1 (826) 555-4081 190.137.223.204 du", "épa un. +1 (843) 555-7672 170.106.47.218 Et", "call (030) 555-0199 (040) 555-0188 today", "tel: 190.137.223.204 (030) 555-0199 and on",
        "call (030) 555-0199 4111 1111 1111 1111 now", "isbn 978-3-16-148410-0 and 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "x " + "1 " * 3000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(k, texts[r["doc_id"]][int(a) : int(b)]) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.digests(docs).collect()}
    assert ("phone", "+1 (826) 555-4081") in found[0] and ("ip", "190.137.223.204") in found[0]
    assert ("phone", "+1 (843) 555-7672") in found[1]
    assert [v for k, v in found[2] if k == "phone"] == ["(030) 555-0199", "(040) 555-0188"]
    assert ("phone", "(030) 555-0199") in found[3] and ("phone", "(030) 555-0199") in found[4]
    assert found[5] == [] and found[6] == []
    for spans in found.values():
        assert len(spans) == len(set(spans))
    done = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert "555" not in "".join(done[:5])


def test_many_spans_in_one_text(spark):
    n = 12_000
    text = " ".join(f"a{k}@b.com c{k} [at] d.org" for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.digests(docs).first()
    assert row["n_email"] == n and row["spans"].count(",") == 2 * n - 1
    assert pii.redact(docs).first()["text"] == " ".join(["<EMAIL> <EMAIL>"] * n)
    assert time.time() - began < 90


def test_overlapping_spans_are_replaced_once(spark):
    texts = ["x user1234.4111111111111111@mail.com y", "a@b.c" + " long" * 3000 + " d@e.f end", "😀 1.2.3.4 😀"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert got == ["x <EMAIL> y", "<EMAIL>" + " long" * 3000 + " <EMAIL> end", "😀 <IP> 😀"]


def test_halves_of_the_examples_share_no_template(spark):
    assert all(len(set(w)) == len(w) and len(w) % 2 == 0 for w in pii.WORDS.values())
    ex = pii.examples(spark).collect()
    shape = lambda r: (r["kind"], r["label"], re.sub("[0-9]", "9", re.sub("[a-f0-9]{12,}", "h", r["before"] + "|" + r["value"] + "|" + r["after"])))
    one, two = ({shape(r) for r in ex if r["half"] == h} for h in (0, 1))
    assert one and two and not one & two
    for kind in pii.WIDE:
        assert {r["label"] for r in ex if r["kind"] == kind and r["half"] == 0} == {r["label"] for r in ex if r["kind"] == kind and r["half"] == 1} == {0.0, 1.0}


def test_plans_stay_small_behind_filters(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    spans = pii.with_spans(docs).select("doc_id", F.explode("spans").alias("s")).where("s.kind <> 'ip'")
    assert spans.count() > 0
    assert pii.digests(pii.redact(docs)).where("n_email > 0").count() == 0
