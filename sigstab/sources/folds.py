"""Folders of folds: a folder for each outer fold, in it one for each filter option, in these the matrices as files.

The tree reads as one long matrix with a column for the fold and the option it came from. Spark lists the files, so they may
lie in any store that it reads. Each fold's matrix is a branch of a union with its fold as a constant, so a filter by fold
leaves the other folds' files unread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import matrix

#: Options in the order in which they are preferred, and the names of their files.
OPTIONS = ("filter", "noFilter")
FILES = {
    "filter": {"train": "train_including_correlated_genes.csv", "test": "test_including_correlated_genes.csv"},
    "noFilter": {"train": "dataset_train_without_correlated_genes.csv", "test": "dataset_test_without_correlated_genes.csv"},
}


def found_folds(spark: SparkSession, path: str) -> DataFrame:
    """fold, option, part ("train", "test"), file: of each fold the files of the first option that it has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    names = "|".join(f.replace(".", r"\.") for o in OPTIONS for f in FILES[o].values())
    pattern = rf"^(.*/([^/]+)/({'|'.join(OPTIONS)})/({names}))(?:/[^/]*)?$"  # a matrix is a file or a folder that Spark wrote
    cut = lambda k: F.regexp_extract("path", pattern, k)
    part = F.when(F.col("name").contains("train"), "train").otherwise("test")
    seen = files.select(cut(1).alias("file"), cut(2).alias("fold"), cut(3).alias("option"), cut(4).alias("name")).where("file <> ''").distinct()
    order = F.array_position(F.array(*map(F.lit, OPTIONS)), F.col("option"))
    best = F.min(order).over(Window.partitionBy("fold"))
    return seen.withColumns({"part": part, "_best": best, "_order": order}).where("_order = _best").select("fold", "option", "part", "file")


def read_folds(spark: SparkSession, path: str, part: str = "train", folds: tuple[str, ...] | None = None) -> DataFrame:
    """fold, option and the long matrix of every fold's training (or test) rows; ``folds`` reads some of them only."""
    found = sorted((r["fold"], r["option"], r["file"]) for r in found_folds(spark, path).where(F.col("part") == part).collect())
    chosen = [x for x in found if folds is None or x[0] in folds]
    if not chosen:
        raise FileNotFoundError(f"{path} has no folds with {' or '.join(OPTIONS)}")
    each = [matrix.read_csv(spark, file).select(F.lit(fold).alias("fold"), F.lit(option).alias("option"), "*") for fold, option, file in chosen]
    return reduce(DataFrame.unionByName, each)


def write_folds(obs: DataFrame, path: str, option: str = "filter") -> None:
    """The tree that ``read_folds`` reads, of rows with fold and is_test; the folds are few."""
    for fold in sorted(r[0] for r in obs.select("fold").distinct().collect()):
        for part, some in (("train", F.col("is_test") == F.lit(False)), ("test", F.col("is_test"))):
            matrix.write_csv(obs.where((F.col("fold") == fold) & some), f"{path}/{fold}/{option}/{FILES[option][part]}")
