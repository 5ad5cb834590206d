"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

1. Each source gets a target: its weight's part of ``share`` times all words, at most ``most`` times its own words,
   the excess going to the other sources by weight (``targets``).
2. A source's documents fall by hash into blocks, whose number follows the source's rows up to BLOCKS. A draw is a copy
   number and a block; first copies come before second ones, each copy in a permuted order. A source's quota is the
   draws that reach its target; of the last one only the words still missing are taken, so quotas are exact in words.
3. The tree deals the quotas to the output shards: a node halves its draws by a multivariate hypergeometric sample of
   its counts by source, down to one shard a leaf (``split_quotas``). Only the counts by source move here.
4. Each source's draws, permuted anew, fill the shards' quotas in turn, so the shards draw disjoint blocks; the rows of
   a shard are then shuffled inside it (``mix``). A shard's order is cut into 2 ** PIECE_BITS runs, so no task holds a whole shard.

All randomness is a hash of the seed, ids and positions, so reruns agree. A hot source is spread over its blocks.

Defined results: null texts have size 0; the null source is a source, last in order; sources without words get target
0; an empty table gives an empty result; repeated rows count and are taken each on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, n_words, text_of

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 17
#: Blocks of a source at most, rows of a block at least (about), words of an output shard about, levels of the tree at most.
BLOCKS, BLOCK_ROWS, SHARD_WORDS, LEVELS = 8192, 32, 4_000_000, 12
#: Runs of a shard, by the leading PIECE_BITS of a row's place in the shard's order.
PIECE_BITS = 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, rows, source_size, place (from 0), target for (source, size); windows run over one row a source only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    by = by.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    # Sources stop at their cap in the order of cap / weight. The level is the words for each unit of weight that is left.
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0.0))
    by = (
        by.withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("level", (share * F.sum("source_size").over(every) - before(F.col("cap"))) / (F.sum("weight").over(every) - before(F.col("weight"))))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    )
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return by.select("source", "rows", "source_size", "place", target.alias("target"))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` items are among the ``good``, by inversion of the uniform ``u``.

    Probabilities are taken relative to the mode's, going up from it and then down, as far as 12 standard deviations.
    """
    total, good, drawn = (c.cast("double") for c in (total, good, drawn))
    lo, hi = F.greatest(F.lit(0.0), drawn + good - total), F.least(drawn, good)
    mode = F.least(hi, F.greatest(lo, F.floor((drawn + 1) * (good + 1) / (total + 2)).cast("double")))
    spread = 12 * F.sqrt(drawn * (good / F.greatest(total, F.lit(1.0))) * (1 - good / F.greatest(total, F.lit(1.0)))) + 12

    def search(p: Column) -> Column:
        total, good, drawn, u, lo, hi, mode = (p[k] for k in ("total", "good", "drawn", "u", "lo", "hi", "mode"))
        up = F.when(hi > mode, F.sequence(mode.cast("long") + 1, hi.cast("long"))).otherwise(F.array().cast("array<long>"))
        down = F.when(mode > lo, F.sequence(mode.cast("long") - 1, lo.cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
        rise = lambda k: (good - k + 1) * (drawn - k + 1) / (k * (total - good - drawn + k))  # noqa: E731  p(k) / p(k - 1)
        fall = lambda k: (k + 1) * (total - good - drawn + k + 1) / ((good - k) * (drawn - k))  # noqa: E731  p(k) / p(k + 1)
        start = lambda s: F.struct(F.lit(1.0).alias("w"), s.alias("sum"), F.lit(None).cast("long").alias("k"))

        def walk(steps: Column, ratio, begin: Column, goal: Column) -> Column:
            def step(s: Column, k: Column) -> Column:
                return _let(s["w"] * ratio(k.cast("double")), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), F.coalesce(s["k"], F.when(s["sum"] + w > goal, k)).alias("k")))

            return F.aggregate(steps, begin, step)

        never = F.lit(float("inf"))
        mass = walk(down, fall, start(walk(up, rise, start(F.lit(1.0)), never)["sum"]), never)["sum"]

        def find(goal: Column) -> Column:
            above = walk(up, rise, start(F.lit(1.0)), goal)
            return F.when(goal < 1, mode.cast("long")).otherwise(_let(above, lambda a: F.coalesce(a["k"], walk(down, fall, start(a["sum"]), goal)["k"], mode.cast("long"))))

        return _let(u * mass, find)

    names = {"total": total, "good": good, "drawn": drawn, "u": u, "lo": F.greatest(lo, mode - F.ceil(spread)).cast("double"), "hi": F.least(hi, mode + F.ceil(spread)).cast("double"), "mode": mode}
    return _let(F.struct(*[c.alias(n) for n, c in names.items()]), search)


def split_quotas(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """place, ends: for each source the running quotas of the 2 ** levels shards, for (place, draws).

    One row a node: the counts by source, halved level by level.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("place", F.col("draws").cast("long").alias("n")))).alias("s")).select(
        F.lit(1).cast("long").alias("node"), F.transform("s", lambda x: x["place"]).alias("places"), F.transform("s", lambda x: x["n"]).alias("counts")
    )
    for level in range(levels):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
        # an odd draw goes left or right by the node's hash
        half = F.floor((total + F.pmod(F.xxhash64(F.lit(seed), F.lit("half"), "node"), F.lit(2))) / 2).cast("long")
        numbered = F.transform("counts", lambda n, i: F.struct(n.alias("n"), i.alias("i")))
        begin = F.struct(total.alias("left"), half.alias("want"), F.array().cast("array<long>").alias("out"))

        def take(s: Column, c: Column) -> Column:
            x = hypergeometric(s["left"], c["n"], s["want"], _uniform(F.lit(seed), F.lit("split"), F.col("node"), c["i"]))
            return _let(x, lambda x: F.struct((s["left"] - c["n"]).alias("left"), (s["want"] - x).alias("want"), F.concat(s["out"], F.array(x)).alias("out")))

        node = node.withColumn("one", F.aggregate(numbered, begin, take)["out"])
        halves = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("one").alias("counts")), F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("counts", "one", lambda a, b: a - b).alias("counts")))
        node = node.select("places", F.explode(halves).alias("h")).select("h.node", "places", "h.counts")
        if level % 3 == 2:
            node = checkpointed(node)
    each = node.select((F.col("node") - (1 << levels)).alias("shard"), F.explode(F.arrays_zip("places", "counts")).alias("c")).select("shard", F.col("c.places").alias("place"), F.col("c.counts").alias("n"))
    parts = each.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("s"))
    running = F.aggregate("s", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["n"])))
    return parts.select("place", F.slice(running, 2, 1 << levels).alias("ends"))


def draws(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """place, block, source, source_size, target, and draws: an array of (copy, words, shard), for (source, size, h), all blocks of all sources.

    ``words`` is how many words of the block the draw takes, all but for a source's last draw.
    """
    by = checkpointed(targets(sized))
    blocks = in_blocks(sized, by).groupBy("place", "block").agg(F.sum("size").alias("words"))
    quota = by.select("place", F.round("target").cast("long").alias("quota"))
    each = blocks.join(quota, "place").select("*", F.explode(F.array(*map(F.lit, range(MOST)))).alias("copy"))
    order = Window.partitionBy("place").orderBy("copy", F.xxhash64(F.lit(seed), F.lit("order"), "place", "copy", "block"), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = each.withColumn("take", F.least(F.col("words"), F.col("quota") - before)).where("take > 0")
    again = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed), F.lit("deal"), "place", "copy", "block"), "copy", "block")
    used = checkpointed(used.withColumn("number", F.row_number().over(again)))
    words = used.agg(F.sum("take")).first()[0] or 0
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, words / SHARD_WORDS)))))
    dealt = used.join(split_quotas(used.groupBy("place").agg(F.count(F.lit(1)).alias("draws")), levels, seed), "place")
    shard = F.size(F.filter("ends", lambda e: e < F.col("number")))
    found = dealt.select("place", "block", F.struct("copy", F.col("take").alias("words"), (F.col("take") == F.col("words")).alias("whole"), shard.alias("shard")).alias("d"))
    return found.groupBy("place", "block").agg(F.sort_array(F.collect_list("d")).alias("draws")), by


def in_blocks(sized: DataFrame, by: DataFrame) -> DataFrame:
    """The rows with their source's figures and block; the sources' table is joined as Spark sees its size."""
    n = F.least(F.lit(BLOCKS), F.ceil(F.col("rows") / BLOCK_ROWS))
    by = by.withColumnRenamed("source", "_source")
    return sized.join(by, F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", F.pmod("h", n)).drop("_source", "rows")


def taken(sized: DataFrame, seed: int = SEED, all_rows: DataFrame | None = None) -> DataFrame:
    """The rows of ``all_rows`` (else ``sized``) with source_size, target, taken, and draws: (copy, words, whole, shard, taken).

    ``sized`` has source, size and h and is read several times; ``all_rows`` may carry more columns, texts for example.
    """
    drawn, by = draws(sized, seed)
    rows = in_blocks(sized if all_rows is None else all_rows, by).join(drawn, ["place", "block"], "left")
    inside = Window.partitionBy("place", "block").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    each = F.transform("draws", lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.when(d["whole"], F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), d["words"] - F.col("_before")))).alias("taken")))
    rows = rows.withColumn("draws", F.filter(F.coalesce(each, F.array().cast("array<struct<copy:int,shard:int,taken:bigint>>")), lambda d: d["taken"] > 0))
    return rows.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["taken"])).drop("_before", "place", "block")


def with_sizes(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """All columns, size, and h, the hash that deals a row to its block and place."""
    return docs.withColumn("size", n_words(F.col("text"))).withColumn("h", F.xxhash64(F.lit(seed), id_col, "size"))


def decide(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """id, size, source_size, target, taken and the shards of its copies, for every document."""
    sized = checkpointed(with_sizes(docs.select(id_col, "source", "text"), id_col, seed).select(id_col, "source", "size", "h"))
    return taken(sized, seed).select(id_col, "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mix itself: a row for each copy taken, with the columns of ``docs``, dealt to shards and shuffled inside them.

    A source's last document is cut to the words that its target still asks for. A row travels as one struct, so its
    columns may have any name and come back as they were.
    """
    narrow = checkpointed(with_sizes(docs.select(id_col, "source", "text"), id_col, seed).select("source", "size", "h"))
    whole = with_sizes(docs.select(F.col(id_col).alias("id"), "source", "text", F.struct("*").alias("row")), "id", seed)
    rows = taken(narrow, seed, whole.select("source", "size", "h", "row")).select("row", "size", "h", F.explode("draws").alias("d"))
    parts = F.regexp_extract_all(text_of(F.col("row.text")), F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    cut = F.when(F.col("d.taken") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(parts, 1, F.col("d.taken").cast("int")), ""))
    place = F.xxhash64(F.lit(seed), F.lit("shuffle"), "d.shard", "d.copy", "h")
    out = rows.select("row", cut.alias("cut"), F.col("d.shard").alias("shard"), place.alias("place"))
    out = out.repartition(F.col("shard"), F.shiftrightunsigned("place", 64 - PIECE_BITS)).sortWithinPartitions("shard", "place")
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
