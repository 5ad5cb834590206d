"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds. DataFrame functions only.

``BASE`` kinds are exact patterns with checks; their spans always stay. Besides, high-recall generators (``WIDE``) propose
further spans, which may overlap: credentials, national phone numbers, written-out mail addresses, card numbers with
other separators, and long internet addresses. They read the text with base spans blanked out, so what stands beside a
base span is proposed as well; a run of figures is proposed as a whole and in parts (``_parts``), as several numbers may
stand in it. Gradient-boosted trees score each candidate by its format and by the CONTEXT characters on either side. They
are trained on a synthetic table that this module makes by rule (``examples``): of its templates one half trains, and the
other half, with other words, names and forms, calibrates. A kind's threshold is the lowest score from which on the
calibration half has a precision of PRECISION. Of chosen spans that overlap, those of earlier generators, then those with
higher scores stay.

Extraction and scoring are columns of the row that holds the text; nothing is shuffled, and the trees are an expression.
Patterns use possessive loops, so their time and stack stay bounded on long runs of one kind of character, and offsets,
overlaps and replacements are worked out by running sums and maxima, so time stays in proportion to the spans of a text
(times the logarithm of their number; a chain of chosen spans that overlap one another costs its square).

Defined results: null texts count as empty (no spans; ``redact`` keeps them null); rows are never merged or dropped.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Leftmost, non-overlapping matches of each kind. A start inside a run that a match could begin earlier can't match, so it isn't tried.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A quick test that each text with a match passes.
MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
WIDE = {
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/-][A-Za-z0-9_+/=-]{18,}+",
    "phone": r"(?<![0-9A-Za-z+.(-])[0-9(][\x20().0-9-]{6,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
MAYBE_WIDE = {"secret": r"[A-Za-z0-9_+/=-]{19}", "phone": r"[0-9][\x20().0-9-]{6}", "email": r"[\[({](?:at|AT)[\])}]", "card": r"[0-9]{4}[._/][0-9]{4}", "ip": r"(?:[0-9A-Fa-f]{1,4}:){3}"}
KINDS = ("email", "ip", "card", "phone", "secret")
CONTEXT = 24
TREES, DEPTH, EXAMPLES, SEED, PRECISION = 12, 3, 6000, 11, 0.98
FEATURES = ("kind", "length", "digits", "digit_share", "letter_share", "distinct", "groups", "luhn", "zero", "ending", "secret_word", "phone_word", "card_word", "mail_word", "address_word", "other_word", "assigned", "phone_after", "other_after", "bracket_inside", "goes_on_before", "goes_on_after")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _is_card(value: Column) -> Column:
    d = _digits(value)
    return F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": _is_card,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _passes(kind: str):
    return lambda s: CHECKS[kind](s["value"])


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


#: What a wide match, or a part of it, has to pass to be a candidate: a row of figures longer than any phone number isn't one.
WIDE_CHECKS = {"phone": lambda v: (F.length(v) <= LONGEST) & F.length(_digits(v)).between(7, 15)}
#: Parts have as many groups of figures as written phone numbers have at most; a whole run may have more.
GROUPS, LONGEST = 6, 24
SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"
#: Stands for each character of a span that is blanked out; no pattern takes it.
BLANK = "\x01"


def _span(kind: Column, start: Column, value: Column, before: Column, after: Column) -> Column:
    return F.struct(kind.alias("kind"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("value"), before.alias("before"), after.alias("after"))


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _running(x: Column, join) -> Column:
    """Running sums (or maxima, ...) of an array: in each round, every element joins the one 1, 2, 4, ... places before it."""
    rounds = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(x))).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
    step = lambda a, d: F.transform(a, lambda v, i: F.when(i >= d, join(v, F.get(a, i - d))).otherwise(v))
    return F.when(F.size(x) > 1, F.aggregate(rounds, x, step)).otherwise(x)


def _hits(text: Column, pattern: str) -> Column:
    """The matches of a text, each with the gaps before and after it."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    beside = lambda gaps, h: F.transform(h, lambda x, i: F.struct(F.get(gaps, i).alias("gap"), x.alias("hit"), F.get(gaps, i + 1).alias("next")))
    both = F.array(F.struct(F.split(text, pattern).alias("gaps"), hits.alias("hits")))
    return F.flatten(F.transform(both, lambda b: beside(b["gaps"], b["hits"])))


def _matches(text: Column, kind: str, pattern: str, maybe: str, trim: bool = False) -> Column:
    """All matches as spans in code points, each with the ends of what stands beside it; ``trim`` cuts closing separators."""

    def spans(pairs: Column) -> Column:
        def span(x: Column, end: Column) -> Column:
            value = F.rtrim(x["hit"], F.lit(" (.-")) if trim else x["hit"]
            cut = F.substring(x["hit"], F.length(value) + 1, F.lit(CONTEXT)) if trim else F.lit("")
            return _span(F.lit(kind), end - F.length(x["hit"]), value, F.substring(x["gap"], -CONTEXT, CONTEXT), F.substring(F.concat(cut, F.substring(x["next"], 1, CONTEXT)), 1, CONTEXT))

        return F.zip_with(pairs, _running(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda u, v: u + v), span)

    found = F.flatten(F.transform(F.array(_hits(text, pattern)), spans))
    return F.when(text.rlike(maybe), found).otherwise(_no_spans())


def _blanked(text: Column, kind: str, pattern: str) -> Column:
    """The text with the characters of the matches that pass as BLANK."""
    fill = lambda x: F.when(CHECKS[kind](x["hit"]), F.repeat(F.lit(BLANK), F.length(x["hit"]))).otherwise(x["hit"])
    joined = lambda h: F.concat(F.array_join(F.transform(h, lambda x: F.concat(x["gap"], fill(x))), ""), F.element_at(h, -1)["next"])
    return F.transform(F.array(_hits(text, pattern)), lambda h: F.when(F.size(h) > 0, joined(h)).otherwise(text))[0]


def _parts(runs: Column) -> Column:
    """The runs, and from each figure group on the spans to the next GROUPS ones' ends: what stands beside other numbers.

    A part is put together from its groups and the separators between them, so the work is in proportion to the groups.
    """
    text = lambda groups: F.array_join(F.transform(groups, lambda g: F.concat(g["before"], g["value"])), "")

    def of(s: Column) -> Column:
        def starting(groups: Column):
            def at(g: Column, i: Column) -> Column:
                bracket = F.when(F.substring(g["before"], -1, 1) == "(", F.lit("(")).otherwise(F.lit(""))
                front = F.concat(s["before"], text(F.slice(groups, F.greatest(F.lit(1), i + 1 - LONGEST // 2), F.least(i, F.lit(LONGEST // 2)))), g["before"])
                before = F.substring(F.substring(front, F.lit(1), F.length(front) - F.length(bracket)), -CONTEXT, CONTEXT)

                def part(h: Column, k: Column) -> Column:
                    value = F.concat(bracket, g["value"], text(F.slice(groups, i + 2, k)))
                    rest = F.concat(text(F.slice(groups, i + k + 2, F.lit(LONGEST // 2))), s["after"])
                    return _span(s["kind"], s["start"] + g["start"] - F.length(bracket), value, before, F.substring(rest, 1, CONTEXT))

                near = F.filter(F.transform(F.slice(groups, i + 1, F.lit(GROUPS)), lambda h, k: F.struct(h.alias("h"), k.alias("k"))), lambda x: (x["h"]["end"] - g["start"] >= 7) & (x["h"]["end"] - g["start"] <= LONGEST))
                return F.filter(F.transform(near, lambda x: part(x["h"], x["k"])), lambda p: F.length(p["value"]) < F.length(s["value"]))

            return at

        groups = F.array(_matches(s["value"], "phone", "[0-9]++", "[0-9]"))
        return F.concat(F.array(s), F.flatten(F.transform(groups, lambda x: F.flatten(F.transform(x, starting(x))))))

    return F.flatten(F.transform(runs, of))


def _chosen(good: Column) -> Column:
    """Of candidates (rank, m, s) that overlap, the best: the least rank, then the highest score m, then the longest.

    In order of their starts, spans fall into chains where a span starts behind the end of all before it; the best are
    taken within each chain.
    """
    apart = lambda out, s: ~F.exists(out, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    take = lambda out, x: F.when(apart(out, x["s"]), F.concat(out, F.array(x["s"]))).otherwise(out)
    by_rank = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(x["rank"].alias("rank"), (-x["m"]).alias("m"), (x["s"]["start"] - x["s"]["end"]).alias("n"), x["s"].alias("s"))))
    best = lambda c: F.when(F.size(c) == 1, F.transform(c, lambda x: x["s"])).otherwise(F.aggregate(by_rank(c), _no_spans(), take))

    def chains(x: Column) -> Column:
        ends = F.array(_running(F.transform(x, lambda c: c["s"]["end"]), F.greatest))
        heads = F.flatten(F.transform(ends, lambda e: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(e, i - 1) <= F.get(x, i)["s"]["start"]))))
        cut = lambda h: F.transform(h, lambda a, j: F.slice(x, a + 1, F.coalesce(F.get(h, j + 1), F.size(x)) - a))
        return F.flatten(F.transform(F.flatten(F.transform(F.array(heads), cut)), best))

    by_start = F.transform(F.sort_array(F.transform(good, lambda x: F.struct(x["s"]["start"].alias("start"), x.alias("x")))), lambda y: y["x"])
    return F.when(F.size(good) > 0, F.flatten(F.transform(F.array(by_start), chains))).otherwise(_no_spans())


def features(kind: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """The numbers that the trees see, in the order of FEATURES; ``before`` and ``after`` are the text beside the value."""
    n, d = F.length(value).cast("double"), _digits(value)
    word = lambda pattern, where=before: where.rlike(f"(?i)({pattern})").cast("double")
    return [
        F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("double"), n, F.length(d).cast("double"), F.length(d) / n,
        F.length(F.regexp_replace(value, "[^A-Za-z]", "")) / n, F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        F.size(F.split(value, "[^0-9A-Za-z]+")).cast("double"), _is_card(value).cast("double"), value.rlike("^[(]?0").cast("double"),
        value.rlike("(?i)(com|org|net|edu|info|io|de|fr|es|uk)$").cast("double"),
        word("token|api.?key|secret|passw|pwd|bearer|credential|private.?key"), word("phone|tel|call|mobile|fax|dial"), word("card|visa|master|credit|account|iban"),
        word("mail|contact|write to|reach"), word("ip|host|server|address"), word("isbn|order|commit|version|page|chapter|date|time|table|ref"), before.rlike("[=:][\\x20]*[\"']?$").cast("double"),
        word("phone|tel|call|mobile|fax|dial|ring", after), word("isbn|order|commit|version|page|chapter|date|time|table|ref", after),
        value.rlike("^.+[(]").cast("double"), before.rlike("[0-9][\\x20().-]{0,3}$").cast("double"), after.rlike("^[\\x20().-]{0,3}[0-9]").cast("double"),
    ]


#: Words that the examples are made of; of each list, one half trains and the other calibrates.
WORDS = {
    "plain": ["and the ", "with other things ", "of a ", "as it was, ", "see ", "number ", "then came ", ""],
    "other": ["isbn ", "order ", "commit ", "page ", "version ", "table ", "date ", "chapter "],
    "secret": ['token = "', "api_key: ", "password: ", "Authorization: Bearer ", "secret=", 'API-KEY = "', "passwd=", "private key: "],
    "phone": ["call ", "tel: ", "fax: ", "call me at ", "phone ", "mobile ", "dial ", "phone no. "],
    "time": ["date ", "on ", "", "in the time of ", "time ", "at ", "since ", "the date is "],
    "mail": ["mail ", "contact ", "", "mail me: ", "write to ", "reach ", "the address ", "or "],
    "card": ["card ", "visa ", "paid with ", "my card no. ", "credit card: ", "account ", "master card ", "from "],
    "host": ["host ", "server ", "", "from host ", "address ", "ip ", "at ", "the server "],
    "name": ["jane.doe", "m_li", "kim", "a.b.c", "office", "sam92", "info", "l-ortega"],
    "domain": ["mail", "example", "web", "firm-x", "post-box", "uni", "home", "cloud9"],
    "ending": ["com", "org", "es", "info", "de", "net", "fr", "io"],
    "late": [" is mine", " and", ".", ", please", " or so", ";", " then", ""],
    "late_phone": [" (mobile)", " is my phone", " after the call", " to call", " (fax)", " is her tel", " when you ring", " by phone"],
    "late_other": [" pages", " as of that date", " is the order", " in version 2", " is the ref", " by the time", " in chapter 3", " of the table"],
    "noun": ["look", "there", "meet", "sit", "run", "here", "stay", "was"],
    "hour": ["noon", "night", "first", "home", "last", "ease", "work", "dawn"],
    "verb": ["then", "we", "it", "he", "they", "you", "so", "she"],
    "long": ["thelongwordthatgoeson", "anotherwordwithoutend", "somethingveryverylong", "nobodywouldreadthis", "allthesmallcharacters", "onelinewithoutablank", "manythingsinasentence", "whateverthiswordmeans"],
}


def examples(spark: SparkSession, rows: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    """A synthetic labelled table by rule: id, half (0 trains, 1 calibrates), kind, label, before, value, after.

    The halves share no word of WORDS and no way of writing a value.
    """
    half = F.pmod("id", F.lit(2)).cast("int")
    number = lambda k, digits: F.lpad(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(10**digits)).cast("string"), digits, "0")

    def pick(k: str, words: str) -> Column:
        per = len(WORDS[words]) // 2
        return F.element_at(F.array(*map(F.lit, WORDS[words])), (half * per + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(per)) + 1).cast("int"))

    either = lambda a, b: F.when(half == 0, a).otherwise(b)
    hexed = lambda k: F.concat(F.md5(number(k, 9)), F.substring(F.md5(number(k + "2", 9)), 1, 8))
    coded = F.substring(F.base64(F.sha2(number("z", 9), 256)), 1, 32)
    plain, other = pick("c", "plain"), pick("o", "other")
    fifteen = number("n", 15)
    check = F.pmod(10 - luhn_sum(F.concat(fifteen, F.lit("0"))) % 10, F.lit(10)).cast("int")
    dotted = lambda last: F.concat_ws(".", *[F.substring(F.concat(fifteen, last.cast("string")), k, 4) for k in (1, 5, 9, 13)])
    card = lambda last: either(dotted(last), F.translate(dotted(last), ".", "/"))
    name, host, ending = pick("m", "name"), pick("h", "domain"), pick("e", "ending")
    national = either(F.concat(F.lit("("), number("a", 3), F.lit(") "), number("b", 3), F.lit("-"), number("d", 4)), F.concat(F.lit("(0"), number("a", 2), F.lit(") "), number("b", 4), F.lit(" "), number("d", 3)))
    beside = either(F.concat(F.lit("("), number("i", 3), F.lit(") "), number("j", 3), F.lit("-"), number("r", 4)), F.concat(F.lit("(0"), number("i", 2), F.lit(") "), number("j", 4), F.lit(" "), number("r", 3)))
    groups = either(F.concat_ws("-", number("a", 3), number("b", 3), number("d", 4)), F.concat_ws(".", F.concat(F.lit("0"), number("a", 3)), number("b", 3), number("d", 3)))
    spaced = either(F.concat_ws(" ", number("a", 3), number("b", 3), number("d", 4)), F.concat_ws(" ", F.concat(F.lit("0"), number("a", 2)), number("b", 4), number("d", 4)))
    dates = either(F.concat(F.lit("20"), number("a", 2), F.lit("-0"), number("b", 1), F.lit("-1"), number("d", 1)), F.concat(F.lit("1"), number("d", 1), F.lit(".0"), number("b", 1), F.lit(".19"), number("a", 2)))
    secret, call, late = pick("t", "secret"), pick("p", "phone"), pick("l", "late")
    six = either(F.concat_ws(":", *[F.substring(F.md5(number(f"v{k}", 9)), 1, 4) for k in range(8)]), F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.upper(F.substring(F.md5(number(f"w{k}", 9)), 1, 3)) for k in range(5)]))
    kinds = [
        ("secret", 1, secret, either(hexed("x"), F.upper(hexed("y"))), late), ("secret", 1, secret, coded, late),
        ("secret", 0, plain, F.concat_ws("-", either(F.lit("chapter"), F.lit("part")), number("a", 2), either(F.lit("of-the-long-story"), F.lit("in-a-series-of-many"))), late), ("secret", 0, other, hexed("u"), late),
        ("secret", 0, plain, F.concat(number("n", 15), number("b", 8)), late), ("secret", 0, plain, F.concat(pick("g", "long"), number("a", 1)), late), ("secret", 0, plain, hexed("s"), late), ("secret", 0, plain, F.repeat(number("a", 1), 24), late),
        ("phone", 1, call, groups, late), ("phone", 1, call, spaced, late), ("phone", 1, F.when(F.col("id") % 4 < 2, call).otherwise(plain), national, late), ("phone", 1, plain, groups, pick("f", "late_phone")),
        ("phone", 1, F.concat(call, beside, F.lit(" ")), national, late),
        ("phone", 1, call, national, F.concat(F.lit(" "), beside, late)), ("phone", 0, F.concat(call, F.regexp_replace(beside, "[0-9]+$", "")), F.concat(F.regexp_extract(beside, "[0-9]+$", 0), F.lit(" "), national), late),
        ("phone", 0, pick("q", "time"), dates, late), ("phone", 0, plain, either(F.concat_ws(" ", number("a", 2), number("b", 3), number("d", 3)), F.concat_ws(" ", number("a", 1), number("b", 3), number("d", 3), number("e", 3))), late),
        ("phone", 0, other, F.concat_ws("-", F.lit("978"), number("a", 1), number("b", 2), number("d", 6), number("e", 1)), late), ("phone", 0, plain, number("n", 12), late),
        ("phone", 0, plain, F.concat_ws(".", number("a", 1), number("b", 2), number("d", 3), number("e", 2)), late), ("phone", 0, plain, groups, pick("k", "late_other")),
        ("email", 1, pick("w", "mail"), F.concat(name, F.lit(" [at] "), host, F.lit(" [dot] "), ending), late), ("email", 1, plain, F.concat(name, either(F.lit("(at)"), F.lit("{AT}")), host, F.lit("."), ending), late),
        ("email", 0, plain, F.concat(pick("m", "noun"), F.lit(" (at) "), pick("h", "hour"), F.lit("."), pick("e", "verb")), late),
        ("card", 1, pick("p", "card"), card(check), late), ("card", 0, plain, card(F.pmod(check + 1 + F.pmod(F.xxhash64("id"), F.lit(8)), F.lit(10))), late),
        ("ip", 1, pick("p", "host"), six, late), ("ip", 0, pick("q", "time"), F.concat_ws(":", number("a", 2), number("b", 2), number("d", 2), either(number("e", 2), number("e", 3))), late),
    ]
    made = [F.struct(F.lit(k).alias("kind"), F.lit(float(y)).alias("label"), F.concat(F.lit("thing "), b).alias("before"), v.alias("value"), a.alias("after")) for k, y, b, v, a in kinds]
    return spark.range(0, rows, 1, 2).withColumn("half", half).withColumn("x", F.array(*made)[F.pmod(F.floor(F.col("id") / 2), F.lit(len(made))).cast("int")]).select("id", "half", "x.*")


def _expression(model, values: list[Column]) -> Column:
    """The margin of the boosted trees as an expression, from the text form of the trees."""

    def tree(lines: list[str]) -> Column:
        line = lines.pop(0).strip()
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        k, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = tree(lines)
        assert lines.pop(0).strip().startswith("Else")
        return F.when(values[int(k)] <= float(cut), left).otherwise(tree(lines))

    each = [tree([x for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in model.trees]
    return reduce(lambda a, b: a + b, [w * t for w, t in zip(model.treeWeights, each, strict=True)])


_trained: dict[tuple, tuple] = {}


def train(spark: SparkSession, rows: int = EXAMPLES, seed: int = SEED) -> tuple:
    """The boosted trees and each kind's threshold. The examples don't depend on any input, so a session trains once."""
    key = (spark.sparkContext.applicationId, rows, seed)
    if key not in _trained:
        ex = examples(spark, rows, seed)
        code = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("double").alias("code")
        seen = zip(FEATURES, features(F.col("kind"), F.col("value"), F.col("before"), F.col("after")), strict=True)
        ex = ex.select("id", "half", "kind", "label", *[x.alias(n) for n, x in seen if n != "kind"], code)
        names = ["code" if n == "kind" else n for n in FEATURES]
        rows_of = VectorAssembler(inputCols=names, outputCol="features").transform(ex.where("half = 0"))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed).fit(rows_of)
        margin = _expression(model, [F.col(n) for n in names])
        found = ex.where("half = 1").groupBy("kind", F.round(margin, 2).alias("m")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
        cuts = {}
        for kind in WIDE:
            good = n = 0
            cuts[kind] = float("inf")
            for r in sorted((r for r in found if r["kind"] == kind), key=lambda r: -r["m"]):
                good, n = good + r["good"], n + r["n"]
                if good >= PRECISION * n and r["m"] > 0:
                    cuts[kind] = r["m"] - 0.005
        _trained[key] = (model, cuts)
    return _trained[key]


def _let(value: Column, body) -> Column:
    """``body`` of the value, worked out once. Unlike a column of its own, it isn't copied into all that refers to it when filters move."""
    return F.transform(F.array(value), body)[0]


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, base_spans and spans: arrays of (kind, start, end, value, before, after), by kind as in KINDS, then by start.

    Each step is a column that refers once to each it is made of, and what it needs more often is bound within, so that
    moving filters through the steps doesn't multiply the plan.
    """
    model, cuts = train(docs.sparkSession)
    rank = lambda s: F.array_position(F.array(*map(F.lit, WIDE)), s["kind"])
    numbers = lambda s: F.struct(s.alias("s"), F.array(*features(s["kind"], s["value"], s["before"], s["after"])).alias("f"))
    margin = lambda c: _expression(model, [c["f"][k] for k in range(len(FEATURES))])
    cut = lambda kind: reduce(lambda a, k: F.when(kind == k, F.lit(cuts[k])).otherwise(a), cuts, F.lit(float("inf")))
    place = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("p"), s["start"].alias("start"), s.alias("s"))

    def found(t: Column) -> Column:
        return F.struct(t.alias("text"), *[F.filter(_matches(t, k, p, MAYBE[k]), _passes(k)).alias(k) for k, p in BASE.items()])

    def blank(m: Column, x: Column, kinds: list[str]) -> Column:
        """The text with the base spans of these kinds blank."""
        if not kinds:
            return m
        return _let(F.when(F.size(x[kinds[0]]) > 0, _blanked(m, kinds[0], BASE[kinds[0]])).otherwise(m), lambda n: blank(n, x, kinds[1:]))

    def rest(x: Column) -> Column:
        """The base spans, numbers after a plus that pass once a base span behind them is blank, and the text without either."""
        base = F.concat(*[x[k] for k in BASE])

        def plus(m: Column) -> Column:
            more = F.when(F.exists(F.array(*[F.size(x[k]) for k in BASE]), lambda n: n > 0), F.filter(_matches(m, "phone", BASE["phone"], MAYBE["phone"]), _passes("phone"))).otherwise(_no_spans())
            return F.struct(more.alias("plus"), m.alias("m"))

        bare = lambda y: F.when(F.size(y["plus"]) > 0, _blanked(y["m"], "phone", BASE["phone"])).otherwise(y["m"])
        return _let(_let(blank(x["text"], x, list(BASE)), plus), lambda y: F.struct(base.alias("base"), y["plus"].alias("plus"), bare(y).alias("m")))

    def candidates(x: Column) -> Column:
        each = []
        for kind, pattern in WIDE.items():
            wide = _matches(x["m"], kind, pattern, MAYBE_WIDE[kind], kind == "phone")
            each.append(F.filter(_parts(wide), lambda s: WIDE_CHECKS["phone"](s["value"])) if kind == "phone" else wide)
        return F.struct(x["base"].alias("base"), x["plus"].alias("plus"), F.transform(F.concat(*each), numbers).alias("c"))

    def good(x: Column) -> Column:
        scored = F.transform(x["c"], lambda c: F.struct(rank(c["s"]).alias("rank"), margin(c).alias("m"), c["s"].alias("s")))
        return F.struct(x["base"].alias("base"), x["plus"].alias("plus"), F.filter(scored, lambda c: c["m"] >= cut(c["s"]["kind"])).alias("good"))

    def every(x: Column) -> Column:
        spans = lambda more: F.when(F.size(more) > 0, F.transform(F.sort_array(F.transform(F.concat(x["base"], more), place)), lambda y: y["s"])).otherwise(x["base"])
        return F.struct(x["base"].alias("base"), _let(F.concat(x["plus"], _chosen(x["good"])), spans).alias("every"))

    df = docs.withColumn("_s", _let(text_of(F.col(text_col)), found))
    for step in (rest, candidates, good, every):
        df = df.withColumn("_s", _let(F.col("_s"), step))
    return df.withColumn("base_spans", F.col("_s.base")).withColumn("spans", F.col("_s.every")).drop("_s")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, the numbers of base spans by kind, base_sha256, and all spans."""
    df = with_spans(docs.select(id_col, "text"))
    counts = [F.size(F.filter("base_spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select(id_col, *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


#: Code points of a block of a text in which replacements look up what they keep.
BLOCK = 4096


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with every span replaced by its kind in angle brackets; n_chars, if there, is counted anew.

    Of spans that overlap, the first (of one start, the longest) gives its kind, and all their characters go. A row
    travels as one struct, so its columns may have any name.
    """
    by_place = lambda spans: F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("longest"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def kept(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(near, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))

    def replaced(x: Column) -> Column:
        t = x["t"]

        def of(x: Column) -> Column:
            spans, ends, blocks = x["spans"], x["ends"], x["blocks"]
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            new = lambda s, i: F.concat(kept(blocks, before(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            pieces = F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), new(s, i)).otherwise(F.lit("")))
            return F.concat(F.array_join(pieces, ""), kept(blocks, F.element_at(ends, -1), F.length(t)))

        def some(spans: Column) -> Column:
            ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
            blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
            return _let(F.struct(spans.alias("spans"), ends.alias("ends"), blocks.alias("blocks")), of)

        return _let(by_place(x["spans"]), lambda p: F.when(F.size(p) > 0, some(p)))

    packed = docs.select(F.col(text_col).alias("text"), F.struct("*").alias("row"))
    df = with_spans(packed).withColumn("_new", _let(F.struct(F.col("text").alias("t"), F.col("spans").alias("spans")), replaced))
    new = {text_col: F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_new").isNotNull(), F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return df.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
