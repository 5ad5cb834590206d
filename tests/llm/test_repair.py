import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

from sigstab.llm import repair

EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string, place long, number int"


def damaged(rows):
    """rows: (conv_id, turn, role, text); a list of (conv_id, turn, role, text, dropped)."""
    out, told = [], lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        row = (conv, turn, "user" if kind == 4 else role, "" if kind <= 1 else re.sub("[.!?]", "", text) if kind == 2 else text, kind == 0)
        out += [row] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired) by trying all edits from each place on; turns: (role, text, fault)."""
    follows = {("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u", ("", "s"): "s"}
    step = lambda state, role: follows.get((state, role[:1]))

    @cache
    def best(i, state, inserts):
        ways = []
        if i == len(turns) and state in ("", "a"):
            ways.append((0, "", ()))
        if i < len(turns):
            role, text, fault = turns[i]
            c, a, r = best(i + 1, state, 0)
            ways.append((2 + c, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                for price, letter, new in ((0, "K", role), (1, "R", "user"), (1, "R", "assistant")):
                    if (to := step(state, new)) is not None:
                        c, a, r = best(i + 1, to, 0)
                        ways.append((price + extra + c, letter + a, (f"{new}:{text}", *r)))
        if inserts < 3:
            for new in ("user", "assistant"):
                if (to := step(state, new)) is not None:
                    c, a, r = best(i, to, inserts + 1)
                    ways.append((5 + c, "I" + a, (f"{new}:", *r)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    return best(0, "", 0)


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text, dropped in rows:
        by[conv] += [] if dropped else [(turn is not None, turn or 0, role, text)]
    out = []
    for conv, turns in by.items():
        turns.sort()
        seen, plain, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", None), 0)
        for _, _, role, text in turns:
            black = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else None
            seen.add((role, text))
            plain.append((role, text, fault))
            count[fault] += 1
        numbers = {t for known, t, *_ in turns if known}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:], strict=False))
        cost, audit, repaired = cheapest(tuple(plain))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_whole_table_against_all_edits(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    rows = damaged([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert collected(repair.repair(repair.damage(turns))) == brute(rows)


def random_rows(seed, convs=150):
    """Short conversations of all roles and faults, ties, nulls and repeated rows; the odd columns clash with results."""
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "well", "", None, "  ", "a b c?", "cut off", "Yes. ", "é…", "“So.”", "x.\x0b"]
    for conv in [None, *range(convs)]:
        for _ in range(rng.randrange(1, 11)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "", None, "usr", "tool", "S", "sys"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 5, 9, -2]), role, rng.choice(texts)))
    return rows


def test_random_conversations_against_all_edits(spark):
    rows = random_rows(4)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert collected(repair.repair(table)) == brute([(c, t, " " if r is None else r, " " if x is None else x, False) for c, t, r, x in rows])
    assert collected(repair.repair(repair.damage(table))) == brute(damaged(rows))
    assert repair.repair(repair.damage(table.limit(0))).count() == 0


def test_repaired_turns_have_the_digest(spark):
    table = spark.createDataFrame([(*r, 1, 2) for r in random_rows(9)], SCHEMA)
    lines = defaultdict(list)
    for r in repair.repaired_turns(table).orderBy("conv_id", "place").collect():
        assert r["place"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert re.fullmatch("[KRI]", r["edit"]) and (r["edit"] != "I" or r["turn"] is None)
    plans = repair.repair(table).collect()
    assert {r["conv_id"]: r["repaired_sha256"] for r in plans} == {r["conv_id"]: hashlib.sha256("\n".join(lines[r["conv_id"]]).encode()).hexdigest() for r in plans}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines[r["conv_id"]])) for r in plans)


def test_a_conversation_whose_turns_are_all_dropped(spark):
    table = spark.createDataFrame([(7, 1, "user", "a.", True), (7, 2, "user", "b.", True)], "conv_id long, turn long, role string, text string, dropped boolean")
    assert collected(repair.repair(table)) == [(7, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_a_long_conversation_holds_little():
    """The open audits stay short over 200,000 turns of noise, and the result equals that without putting anything aside."""
    rng = random.Random(2)
    now, turns, widest = repair.Conversation(), [], 0
    for k in range(200_000):
        role, fault = rng.choice(("user", "assistant", "assistant", "system")), rng.choice((0, 0, 0, 1, 2, 3))
        now.see(k, role, fault)
        now.add(role, f"text {k}.", fault)
        widest = max(widest, *(len(x[1]) for x in now.best.values()))
        turns.append((role, fault))
    assert widest <= repair.OPEN + 200
    gaps, *_, cost, audit, digest = now.report()
    assert gaps == 0 and len(audit.replace("I", "")) == len(turns)
    price = sum({"D": 2, "R": 1, "K": 0, "I": 5}[x] for x in audit)
    steps = iter(turns)
    price += sum(5 * (next(steps)[1] == repair.TRUNCATED and x in "KR") for x in audit if x != "I")
    assert price == cost
