"""Repair of conversation structure: the cheapest edits that make a conversation's turns an alternation of roles.

The dynamic program runs over retained turns, kept or reroled. What a retained turn j costs with the role r is its own
price, the deletions since the retained turn i before it, which are a difference of prefix sums, and the inserts that the
roles of i and j ask for. So a state (the last retained role) needs only its running minimum of cost less prefix sum, and
one pass over a conversation's turns in order is enough. Ties go to the ASCII-least audit: within a gap deletions come
before inserts, and each state carries the audit of its minimum. States that can't be on a cheapest path any more are
dropped, and the part of the audits that all have in common is put aside.

Turns are shuffled once, by conversation, and sorted inside partitions; a text is read once, goes into the running SHA-256
of the states that retain it and isn't held. A conversation of any length is a stream in one task, as its digest is
one: what is held is the open end of a few audits and the audit that is returned.

Defined results: turns go by turn (nulls first), then role, then text, so ties and repeated rows have an order that any
rerun has too; null conversation ids are one conversation; null roles and texts are one space (and in ``damage`` ids and
turns of the key); a conversation without a turn has zeros, an empty audit and the digest of an empty string; an empty
table has no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

BLACK = r"[^\x20\x09-\x0D]"
#: Prices of edits; a truncated turn that stays costs CUT more.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
START, S, U, A = range(4)
USER, ASSISTANT = b"user", b"assistant"
#: Roles to insert between the state before and the state after, where that is possible at all.
BETWEEN = {
    (START, S): (), (START, U): (), (START, A): (USER,), (S, U): (), (S, A): (USER,), (U, U): (ASSISTANT,), (U, A): (), (A, U): (), (A, A): (USER,),
}
ENDING = {START: (), S: (USER, ASSISTANT), U: (ASSISTANT,), A: ()}
OF_INITIAL = {"s": S, "u": U, "a": A}
LEGAL = {"su", "ua", "au"}
#: Characters that open audits may have before their common beginning is put aside; rows of a batch of results.
OPEN, BATCH = 1024, 4096
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Conversation:
    """What is known of a conversation after some of its turns."""

    def __init__(self) -> None:
        self.least = self.last = None
        self.turns = self.illegal = self.prefix = 0
        self.faults = [0, 0, 0, 0]
        self.initial: str | None = None
        self.done: list[str] = []
        #: By state: cost less prefix sum, open audit, digest and number of turns of the repaired beginning.
        self.best = {START: (0, "", hashlib.sha256(), 0)}

    def see(self, turn: int | None, role: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.turns = turn, self.turns + 1
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial

    def add(self, role: str, text: str, fault: int) -> None:
        """Take the next turn."""
        before, self.prefix = self.prefix, self.prefix + DELETE
        fresh = {}
        if fault not in (BLANK, DUPLICATE):
            kept, own = OF_INITIAL.get(role[:1]), CUT * (fault == TRUNCATED)
            line = {U: USER, A: ASSISTANT} | ({kept: role.encode()} if kept else {})
            for to in line:
                price, letter = (own, "K") if to == kept else (own + REROLE, "R")
                ways = [(v + before + INSERT * len(more) + price, audit + "I" * len(more) + letter, q) for q, (v, audit, *_) in self.best.items() if (more := BETWEEN.get((q, to))) is not None]
                if ways:
                    cost, audit, q = min(ways)
                    fresh[to] = (cost - self.prefix, audit, q, line[to])
        old, body = self.best, None
        self.best = {q: (v, audit + "D", *rest) for q, (v, audit, *rest) in old.items()}
        for to, (v, audit, q, who) in fresh.items():
            if to not in self.best or (v, audit) < self.best[to][:2]:
                body = text.encode() if body is None else body
                self.best[to] = (v, audit, *_written(old[q], [*((r, b"") for r in BETWEEN[q, to]), (who, body)]))
        self._drop()

    def _drop(self) -> None:
        """Leave out the states that a state after an assistant's turn beats in every continuation, and shared beginnings."""
        if A in self.best:
            v = self.best[A][0]
            worse = {START: v + DELETE, S: v, U: v + INSERT}
            self.best = {q: x for q, x in self.best.items() if q == A or x[0] <= worse[q]}
        if max(len(x[1]) for x in self.best.values()) > OPEN:
            shared = commonprefix([x[1] for x in self.best.values()])
            self.done.append(shared)
            self.best = {q: (v, audit[len(shared) :], *rest) for q, (v, audit, *rest) in self.best.items()}

    def report(self) -> tuple:
        cost, audit, q = min((v + self.prefix + INSERT * len(ENDING[q]), audit + "I" * len(ENDING[q]), q) for q, (v, audit, *_) in self.best.items())
        digest, _ = _written(self.best[q], [(r, b"") for r in ENDING[q]])
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, cost, "".join(self.done) + audit, digest.hexdigest()


def _written(state: tuple, lines: list[tuple[bytes, bytes]]) -> tuple:
    """The digest and number of turns of a state after further turns; the state's own digest stays as it is."""
    digest, n = state[2].copy(), state[3]
    for role, text in lines:
        digest.update((b"\n" if n else b"") + role + b":")
        digest.update(text)
        n += 1
    return digest, n


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped (null: false) in the order of the module, with the first fault of each turn.

    One shuffle, by conversation: the window over equal turns of a conversation keeps that partitioning.
    """
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    cast = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), cast("role", "string"), cast("text", "string"), dropped.alias("dropped"))
    rows = rows.repartition("conv_id").withColumn("same", F.when(~F.col("dropped"), F.sha2(F.concat("role", F.lit("\0"), "text"), 256)))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(~F.col("text").rlike(BLACK), BLANK).when(earlier, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = rows.withColumn("fault", F.when(F.col("dropped"), 0).otherwise(fault)).drop("same")
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "fault")


def repair(turns: DataFrame) -> DataFrame:
    """For each conversation of (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256.

    A boolean column ``dropped`` marks rows that stand only for their conversation's id.
    """
    rows = ordered(turns)
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL(REPORT).fields])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        now, key = None, None
        for b in batches:
            for conv, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        made.append((key, *now.report()))
                    now, key = Conversation(), conv
                if not dropped:
                    now.see(turn, role, fault)
                    now.add(role, text, fault)
                if len(made) >= BATCH:
                    yield batch(made)
                    made = []
        if now is not None:
            made.append((key, *now.report()))
        if made:
            yield batch(made)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=schema.names)

    return rows.mapInArrow(walk, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns after repair: conv_id, place (from 0), edit (K, R or I), turn, role, text.

    Audits are cut at their deletions, keeps and reroles, one piece for each turn, and joined by conversation and number
    of the turn; a piece's inserts come before its turn.
    """
    same = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "fault")
    rows = ordered(turns).where(~F.col("dropped")).withColumn("number", F.row_number().over(same) - 1)
    pieces = F.split(F.regexp_replace("audit", "([DKR])", "$1,"), ",")
    steps = repair(turns).select(F.col("conv_id").alias("of"), F.posexplode(pieces).alias("number", "piece")).where("piece <> ''")
    found = steps.join(rows, F.col("of").eqNullSafe(F.col("conv_id")) & (steps["number"] == rows["number"]), "left")
    edits = found.select(F.col("of").alias("conv_id"), steps["number"], "turn", "role", "text", F.posexplode(F.regexp_extract_all("piece", F.lit("."), F.lit(0))).alias("k", "edit")).where("edit <> 'D'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("number", "k")) - 1
    first = F.first(F.when(F.col("edit") == "K", F.col("role"))).over(Window.partitionBy("conv_id").orderBy("number", "k"))
    edits = edits.withColumns({"place": place, "system": F.coalesce(first.startswith("s"), F.lit(False))})
    expected = F.when((F.col("place") - F.col("system").cast("int")) % 2 == 0, "user").otherwise("assistant")
    added = F.col("edit") == "I"
    return edits.select(
        "conv_id", "place", "edit", F.when(~added, F.col("turn")).alias("turn"), F.when(F.col("edit") == "K", F.col("role")).otherwise(expected).alias("role"), F.when(added, "").otherwise(F.col("text")).alias("text")
    )


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped: turns damaged by crc32 of 'conv_id:turn' modulo 20, nulls as one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")
