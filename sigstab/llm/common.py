"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space of the word definition; a word is a maximal run of other characters.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column) -> Column:
    """The text, null as the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a whole text; null and blank texts have none."""
    trimmed = F.btrim(text_of(text), F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def id_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids get null."""
    return F.crc32(doc_id.cast("string")) % parts


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in spark.checkpoint.dir.

    A session without that setting gets a folder of its own only in local mode, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file:///tmp/checkpoints")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def map_texts(df: DataFrame, keep: Sequence[str], text_col: str, run: Callable[[list], Sequence], added: str) -> DataFrame:
    """The columns ``keep`` and what ``run`` makes of the texts of an Arrow batch: a list or array for each field of ``added``.

    Rows stay where they are and as many; kept columns, nulls among them, pass untouched.
    """
    cols = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*cols.schema.fields[:-1], *new.fields])
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in new.fields]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(run(b.column(b.num_columns - 1).to_pylist()), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=names)

    return cols.mapInArrow(batches, schema)
