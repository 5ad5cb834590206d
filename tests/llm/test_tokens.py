import random

import sentencepiece
from pyspark.sql import functions as F

from sigstab.llm import tokens

from . import odd

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
STRINGS = ["<s> </s> <unk>", "▁▁ a▁b", "a  b   c", "\n\n\t x", "ﬁ ｱ é́ ​ ﻿", "\x00 null", "😀😀 🇩🇪", "  lead", "trail  ", " ", "　full"]


def test_whole_table_against_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in tokens.count_tokens(docs).collect():
        n = len(LIBRARY.encode(text[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 4096)


def test_odd_documents(spark):
    rows = sorted(tokens.count_tokens(odd.documents(spark)).collect(), key=repr)
    want = sorted([(i, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t, *_ in odd.rows()], key=repr)
    assert sorted([tuple(r)[:3] for r in rows], key=repr) == want
    assert tokens.count_tokens(odd.empty(spark)).count() == 0


def test_odd_strings_at_every_prefix():
    counter = tokens.counter(tokens.default_model())
    for s in STRINGS:
        assert counter.totals([s]) == [len(LIBRARY.encode(s))], s
        assert list(counter.prefix_counts(s)) == [len(LIBRARY.encode(s[:k])) for k in range(len(s) + 1)], s


def test_every_prefix_of_real_texts(spark, small):
    counter = tokens.counter(tokens.default_model())
    rng = random.Random(2)
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(40).collect():
        counts = counter.prefix_counts(r["text"])
        for k in rng.sample(range(len(r["text"]) + 1), min(25, len(r["text"]))):
            assert counts[k] == len(LIBRARY.encode(r["text"][:k]))


def test_budget_questions(spark):
    df = tokens.prefix_table(spark.createDataFrame([(1, "some words that make tokens"), (2, None)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.select("doc_id", tokens.truncate_at(F.col("prefix_tokens"), 3).alias("cut"), tokens.fits(F.col("prefix_tokens"), 3).alias("fits")).collect()}
    text = "some words that make tokens"
    assert got[1]["cut"] == max(k for k in range(len(text) + 1) if len(LIBRARY.encode(text[:k])) <= 3)
    assert not got[1]["fits"] and got[2]["fits"] and got[2]["cut"] == 0
