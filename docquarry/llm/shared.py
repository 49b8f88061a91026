"""Words, batch sizes and tables that every operator of this subpackage uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.values import spare
from docquarry.session import ship
from docquarry.sources.shared import cut, fresh_path, passing, shared_dir

__all__ = ["WORD", "bind", "cut", "fresh_path", "passing", "prepare", "shared_dir", "spare", "spread", "table", "word_count"]

#: What a word is in every operator: a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that one Arrow batch carries to Python; texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 4 * 1024 * 1024
ROWS_KEY, BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Before Python runs on executors: give them this package, and bound what one Arrow batch holds, for tables of long texts.
    The bounds are settings of the session, and stay: plans that are run later depend on them."""
    ship(spark)
    for key, most in ((ROWS_KEY, BATCH_ROWS), (BYTES_KEY, BATCH_BYTES)):
        have = int(spark.conf.get(key).rstrip("bB"))
        if have <= 0 or have > most:
            spark.conf.set(key, str(most))


def spread(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) dealt out over all cores where they lie in fewer files than that: a file of one row group is one task,
    however long its texts take. Tables of many files stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = len(docs._jdf.inputFiles())
    return docs.repartition(cores, "doc_id", F.xxhash64("text")) if 0 < files < cores else docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def word_count(text):
    """Column: the number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
