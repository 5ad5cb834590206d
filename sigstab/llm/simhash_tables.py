"""SimHash near-duplicates at a similarity: many short fingerprints propose in one trie, whole shingle sets confirm.

One fingerprint of 64 bits finds few of the pairs that share 80 % of their shingles: about 10 of the bits differ, and a
budget of 10 prunes nothing. So a text has TABLES fingerprints of PRINT bits, each from hash bits of its own, and two
texts are candidates if any of them differ in at most BUDGET bits. At a similarity of 0.8 a bit differs with a probability
of 0.15, a table finds the pair with 0.054, and TABLES tables find 0.91 of such pairs; at 0.85 they find 0.995, and nearly
all above. Unlike texts come together in a table with a probability of 6.6e-11.

The trie join of :mod:`simhash` walks all tables at once: the other bits of a fingerprint hold its table's word of a code
in which two words differ in more than BUDGET bits, so links never cross tables. The components of a table's links are
buckets for the confirmation of :mod:`minhash`, which compares whole sets and lists no bucket's pairs.

Defined results: null, empty and blank texts are one class, linked with no other; texts with equal sets are one class;
component_id is the smallest id that is reachable, nulls ignored (null if all ids of a component are null); repeated rows
stay repeated in ``near_duplicates``, and ``deduplicate`` keeps one of them; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, map_texts
from .minhash import class_roots, shingle_set, text_key
from .simhash import BITS, BUDGET, QUARTER, components, links

PERCENT = 80
TABLES, PRINT = 44, 48
#: Fingerprints below a node where groups of the trie begin, about.
NODE = 32_768
#: Hashes whose bits are added up at once; their counts fit a byte.
ADDED = 255
WORDS = -(-TABLES * PRINT // 64)


def code_words(many: int = TABLES) -> list[int]:
    """The least numbers that differ from each other in more than BUDGET bits, in order."""
    out: list[int] = []
    x = 0
    while len(out) < many:
        if all((x ^ y).bit_count() > BUDGET for y in out):
            out.append(x)
        x += 1
    return out


def _places() -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of a print and of its table's word lie: each quarter begins with print bits."""
    k = np.arange(BITS)
    inside = k % QUARTER < PRINT * QUARTER // BITS
    return k[inside], k[~inside]


def _frame() -> np.ndarray:
    """A row of BITS zeros and ones for each table, with its word in place."""
    _, code = _places()
    bits = np.zeros((TABLES, BITS), np.uint8)
    bits[:, code] = np.array(code_words())[:, None] >> np.arange(BITS - PRINT) & 1
    return bits


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """WORDS further 64-bit hashes of each hash."""
    x = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints(hashes: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of shingles, one of each table; a bit is 1 if it is in over half of the shingles."""
    ones = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(hashes), ADDED):
        bits = np.unpackbits(_mixed(hashes[k : k + ADDED]).astype("<u8").view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    out = frame.copy()
    out[:, _places()[0]] = (2 * ones > len(hashes))[: TABLES * PRINT].reshape(TABLES, PRINT)
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.int64)


def signatures(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The kept columns, n_shingles, same (16 bytes that equal sets share) and sig, the fingerprints of all tables."""

    def run(texts: list) -> list:
        frame = _frame()
        sets = [shingle_set(t) for t in texts]
        return [[len(s) for s in sets], [xxhash.xxh128_digest(s.tobytes()) for s in sets], [prints(s, frame) for s in sets]]

    return map_texts(docs, keep, text_col, run, "n_shingles long, same binary, sig array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """band, key, cls, n for every class of a component of a table that has several, many of them, and its least class."""
    rows = classes.select("cls", "n", F.explode("sig").alias("fp"))
    met = checkpointed(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("many")))
    roots = components(links(met.select("fp"), node=NODE))
    linked = roots.union(roots.select("root", "root").distinct())  # with the roots, of which ``components`` has no rows
    several = met.where("many > 1").select("fp")
    found = several.join(linked, several["fp"] == linked["node"], "full").select(F.coalesce("node", "fp").alias("fp"), F.coalesce("root", "fp").alias("key"))
    keyed = checkpointed(rows.join(found, "fp").select("cls", "n", "key"))  # most prints have no other class, and go no further
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("cls").alias("least"))
    return keyed.join(shared, "key").select(F.lit(0).alias("band"), "key", "cls", "n", "many", "least")


def _rooted(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """same, root, and the row of the least id (no_id, id, h1, h2) for every class of (id, h1, h2, n_shingles, same, sig)."""
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")).alias("row")
    classes = found.groupBy("same").agg(F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), least)
    classes = checkpointed(classes.select("same", "n", "sig", "row.*"))
    classes = classes.withColumn("cls", F.monotonically_increasing_id())  # of stored partitions: the same at each reading
    worded = classes.where("n > 0")
    roots = class_roots(docs, worded, _buckets(worded), id_col, text_col, percent)
    return classes.join(roots, classes["cls"] == roots["node"], "left").select("same", "no_id", "id", "h1", "h2", F.coalesce("root", "cls").alias("root"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h1, h2, text, row: a row travels as one struct, so its columns may have any name."""
    return docs.select(F.col(id_col).alias("id"), *text_key(text_col), F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id for every row; see the module for what is defined."""
    found = checkpointed(signatures(_keyed(docs, id_col, text_col).drop("row"), ("id", "h1", "h2"), "text"))
    rooted = _rooted(docs, found, id_col, text_col, percent)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return found.select("id", "n_shingles", "same").join(rooted.select("same", "root").join(least, "root"), "same").select(F.col("id").alias(id_col), "n_shingles", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component stays, whole: one whose id is the component's smallest (with rows alike, any of them)."""
    packed = _keyed(docs, id_col, text_col)
    found = checkpointed(signatures(packed.drop("row"), ("id", "h1", "h2"), "text"))
    rooted = _rooted(docs, found, id_col, text_col, percent)
    stay = rooted.groupBy("root").agg(F.min(F.struct("no_id", "id", "h1", "h2")).alias("k")).select(F.struct("k.id", "k.h1", "k.h2").alias("key"))
    key = F.struct("id", "h1", "h2").cast(stay.schema["key"].dataType)  # with another type the window would shuffle whole rows again
    rows = packed.select(key.alias("key"), "row").join(stay, "key", "left_semi")
    one = Window.partitionBy("key").orderBy(F.lit(0))
    return rows.withColumn("number", F.row_number().over(one)).where("number = 1").select("row.*")
