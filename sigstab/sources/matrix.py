"""Labelled matrices: the long form ``obs`` (sample_id, label, y, feature, feature_pos, value), files, and views of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_arrays(df: DataFrame, sample: Column, label: Column, values: Column, width: int) -> DataFrame:
    """Long form of rows that hold their features as an array; codes follow the order of labels."""
    rows = df.select(sample.alias("sample_id"), label.cast("string").alias("label"), F.posexplode(values).alias("feature_pos", "value")).where(F.col("feature_pos") < width)
    return rows.select("sample_id", "label", F.concat(F.lit("f"), F.lpad(F.col("feature_pos").cast("string"), 2, "0")).alias("feature"), "feature_pos", F.col("value").cast("double").alias("value"))


def with_codes(obs: DataFrame) -> DataFrame:
    """Add y, the label's place in sorted order; the levels are a small table, and Spark broadcasts it by its size."""
    levels = class_levels(obs).select("label", "y")
    return obs.join(levels, "label")


def class_levels(obs: DataFrame) -> DataFrame:
    """label, y, n (samples)."""
    n = obs.groupBy("label").agg(F.count_distinct("sample_id").alias("n"))
    return n.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("y"), "n")


def embeddings(spark: SparkSession, sf_dir: str, classes: int) -> DataFrame:
    """The embeddings as a labelled matrix of 64 features in ``classes`` classes."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    obs = from_arrays(df, F.col("vec_id"), F.concat(F.lit("c"), F.col("label") % classes), F.col("embedding"), 64)
    return obs.withColumn("y", F.substring("label", 2, 5).cast("int"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label (l_returnflag), feature, value of four measures of the lineitems: a tall matrix without sample ids."""
    measures = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("label"), *measures)
    return df.unpivot("label", list(measures), "feature", "value")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label (quality) of the documents that have one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("string").alias("label"))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Long form of a matrix file whose rows are features: line 1 has sample names, line 2 labels, then name and values.

    All spaces are dropped from every cell. Empty cells and cells that aren't numbers are null; short lines lack their last
    samples. Only the two head lines come to the driver, from the start of the first file; the rest is read by row, and the
    names and labels of the samples are joined to it as a table.
    """
    raw = spark.read.text(path)
    first = raw.agg(F.min("_metadata.file_path")).first()[0]
    head = [r[0] for r in raw.where((F.col("_metadata.file_path") == first) & (F.col("_metadata.file_block_start") == 0)).select("value").limit(2).collect()]
    if len(head) < 2:
        raise ValueError(f"{path} lacks its lines of sample names and labels")
    names, labels = ([x.strip() for x in h.replace("\ufeff", "").replace(" ", "").replace('"', "").split(sep)][1:] for h in head)
    codes = {x: y for y, x in enumerate(sorted(set(labels)))}
    samples = spark.createDataFrame([(k, n, x, codes[x]) for k, (n, x) in enumerate(zip(names, labels, strict=True))], "sample_pos int, sample_id string, label string, y int")
    cells = F.split(F.regexp_replace("value", '[\ufeff \r"]', ""), f"[{sep}]")
    rows = _below_head(raw, first, head).select(cells.alias("cells")).select(F.col("cells")[0].alias("feature"), F.posexplode(F.slice("cells", 2, len(names))).alias("sample_pos", "value"))
    return rows.where("feature <> ''").join(samples, "sample_pos").select("sample_id", "sample_pos", "label", "y", "feature", F.expr("try_cast(value as double)").alias("value"))


def _below_head(raw: DataFrame, first: str, head: list[str]) -> DataFrame:
    """The lines without the two head lines, each taken away once: where the first file begins, in their order.

    Lines like a head line are data elsewhere. Only such lines are numbered, so the window is as long as there are copies.
    """
    start = (F.col("_metadata.file_path") == first) & (F.col("_metadata.file_block_start") == 0)
    lines = raw.select("value", start.alias("start"), F.monotonically_increasing_id().alias("line"))
    alike = lines.where(F.col("start") & F.col("value").isin(head)).groupBy("value").agg(F.sort_array(F.collect_list("line")).alias("at"))
    gone = {}
    for r in alike.collect():
        gone[r["value"]] = r["at"][: head.count(r["value"])]
    taken = [k for at in gone.values() for k in at]
    return lines.where(~F.col("line").isin(taken)).select("value") if taken else lines.select("value")


def with_positions(obs: DataFrame) -> DataFrame:
    """Add feature_pos: the place of a feature among all by name."""
    names = obs.select("feature").distinct()
    return obs.join(names.withColumn("feature_pos", F.row_number().over(Window.orderBy("feature")) - 1), "feature")


def to_frame(obs: DataFrame, samples: list) -> DataFrame:
    """The file's layout: a row for each feature with a column for each sample."""
    return obs.groupBy("feature").pivot("sample_id", samples).agg(F.first("value")).orderBy("feature")


def write_csv(obs: DataFrame, path: str) -> None:
    """The matrix in the layout that ``read_csv`` reads, in a folder with one file: names, labels, and a line for each feature."""
    samples = [tuple(r) for r in obs.select("label", "sample_id").distinct().orderBy("label", "sample_id").collect()]
    wide = to_frame(obs, [s for _, s in samples])
    body = wide.select(F.lit(2).alias("k"), F.concat_ws(",", "feature", *[F.col(f"`{s}`").cast("string") for _, s in samples]).alias("value"))
    head = obs.sparkSession.createDataFrame([(0, "," + ",".join(str(s) for _, s in samples)), (1, "Protein," + ",".join(x for x, _ in samples))], "k int, value string")
    head.union(body).coalesce(1).sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)


def read_ragged(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """row_id, pos, feature of a headerless file with lists of features (signatures, or a kept feature and those it dropped).

    Empty cells are left out; equal lines are rows of their own.
    """
    lines = spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id())
    cells = lines.select("row_id", F.posexplode(F.split("value", sep)).alias("pos", "feature"))
    return cells.withColumn("feature", F.trim("feature")).where("feature <> ''")


def read_groups(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """kept, dropped (array) of a file of correlation groups; no rows if there is no such file."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "kept string, dropped array<string>")
    cells = lines.select(F.filter(F.transform(F.split("value", sep), lambda x: F.trim(x)), lambda x: x != "").alias("cells")).where(F.size("cells") > 0)
    return cells.select(F.col("cells")[0].alias("kept"), F.slice("cells", 2, F.size("cells")).alias("dropped"))


def write_ragged(groups: DataFrame, path: str) -> None:
    """kept, dropped (array): a line for each, padded to the same number of cells."""
    width = groups.agg(F.max(F.size("dropped"))).first()[0] or 0
    cells = F.concat(F.array("kept"), "dropped", F.array_repeat(F.lit(""), (F.lit(width) - F.size("dropped")).cast("int")))
    groups.orderBy("kept").select(F.concat_ws(",", cells).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_rank(spark: SparkSession, path: str) -> DataFrame:
    """index, name, score of a rank file."""
    return spark.read.csv(path, header=True, schema="index int, name string, score double")


def write_rank(scores: DataFrame, path: str) -> None:
    """(index, name, score) with six decimals, best first."""
    scores.orderBy(F.desc("score"), "name").select("index", "name", F.format_string("%f", "score").alias("score")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """feature, method, score of a table with a column for each method; features that a method lacks have no row."""
    wide = spark.read.csv(path, header=True)
    name, *methods = wide.columns
    long = wide.withColumnRenamed(name, "feature").unpivot("feature", methods, "method", "score")
    return long.withColumn("score", F.expr("try_cast(score as double)")).where("score is not null")


def write_table(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """A small result table (names, scores or positions by method) as one file with a header."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_annotations(spark: SparkSession, path: str, multi: tuple[str, ...] = ()) -> DataFrame:
    """An annotation file; columns in ``multi`` become arrays, split at semicolons."""
    df = spark.read.csv(path, header=True)
    return reduce(lambda d, c: d.withColumn(c, F.split(c, r";\s*")), multi, df)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text column as plain lines: trees, lists of names, reports."""
    df.select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)
