"""Quality rules as a bitmask ledger, with DataFrame functions only.

``ledger`` measures every document and evaluates every rule once: bit k of ``fail_bits`` is set if rule k fails.
Policies are versioned sets of rules that are applied to the stored bits, and ``ablations`` counts what each rule of a
policy decides from the distinct bit patterns, of which there are at most 2 ** len(RULES), without reading a text again.

Defined results: a null text counts as empty (no words, so ``few_words`` fails); empty tables give empty results; rows
are never merged, so repeated rows give repeated results; columns of the input that clash with a measurement's name
are replaced by it in ``ledger``; ``verdicts`` and ``keep`` read the text alone, and leave such columns as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of, words

#: (name, when it fails), by bit. Shares are per cent in whole numbers, so every engine decides alike.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 6 * word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("exclamations", "100 * n_exclamations > 10 * word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(BIT))
POLICIES = (BASE, STANDARD)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in 3-word windows that occur twice or more in the text, the first included.

    Windows are compared as text. Only texts whose windows are not all distinct are sorted.
    """
    at = lambda i: F.get(F.col("_w"), i)
    df = df.withColumn("_g", F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.concat_ws(" ", at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<string>")))
    placed = F.sort_array(F.transform(F.col("_g"), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    none = F.array().cast("array<struct<g:string,i:int>>")
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed).otherwise(none))
    same = lambda x, k: F.coalesce(F.get(F.col("_s"), k)["g"] == x["g"], F.lit(False))
    hits = F.filter(F.col("_s"), lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with MEASURES, and ``fail_bits``; store them (a table or checkpoint) before asking about policies."""
    df = docs.withColumn("_t", text_of(F.col(text_col))).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    left = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    df = _repeat_words(df.withColumn("_l", lines)).withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": left(r"[#*$%&|<>]+").cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_capitals": left(r"\p{Lu}+").cast("long"),
            "n_exclamations": left("!+").cast("long"),
        }
    )
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(0).cast("long"))
    # A generator, so that a filter on the bits isn't pushed below it, where it would work out every measurement anew
    made = F.inline(F.array(F.struct(*MEASURES, bits.alias("fail_bits"))))
    return df.select(*[c for c in docs.columns if c not in (*MEASURES, "fail_bits")], made)


def failed(policy: Policy) -> Column:
    """Whether a row of the ledger fails any rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.withColumn("kept", ~failed(policy))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """policy, version, rule, fails, rejects (by the whole policy), only_this (kept again without the rule).

    The ledger is first summed by bit pattern, so what meets in the second sum is bounded by the number of patterns.
    """
    mask = lambda c: F.col("fail_bits").bitwiseAND(F.col(f"p.{c}"))
    each = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(BIT[r]).cast("long").alias("bit")) for p in policies for r in p.rules])
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).alias
    return (
        rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n")).select("fail_bits", "n", F.explode(each).alias("p"))
        .groupBy("p.policy", "p.version", "p.rule")
        .agg(count(mask("bit") != 0)("fails"), count(mask("mask") != 0)("rejects"), count(mask("mask") == F.col("p.bit"))("only_this"))
    )


def verdicts(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id") -> DataFrame:
    """doc_id, the base measurements, base_failed, kept, and the ledger's bits."""
    return apply_policy(ledger(docs.select(id_col, "text")), policy).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed(BASE).alias("base_failed"), (~failed(BASE) & F.col("kept")).alias("kept"), "fail_bits", "n_lines", "n_capitals", "n_exclamations",
    )


def keep(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of ``docs``, untouched, that fail no rule of the policy."""
    whole = F.struct(*docs.columns).alias("_row")
    return ledger(docs.select(whole, "text")).where(~failed(policy)).select("_row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 6 * word_chars)::INT
             + 8 * (100 * n_dup_lines > 40 * n_lines)::INT + 16 * (100 * n_capitals > 50 * word_chars)::INT
             + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
             + 64 * (100 * n_exclamations > 10 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
       fail_bits, n_lines, n_capitals, n_exclamations FROM b
"""
