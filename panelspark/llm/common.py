"""What the corpus operators share: text rules, row keys and tables in the shared folder.

Conventions that hold for every operator of this subpackage:

* An operator looks only at the columns named by its parameters, so other columns (whatever their
  names) can't clash with its own.
* A null text is an empty text, a null key is a key like any other.
* Rows are told apart by (id, 64-bit hash of the text): repeated rows get equal results and stay repeated.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+`` as a Java / RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _scratch() -> str:
    """One new folder for all local sessions of this process; the setting itself can't be changed in a running session."""
    return "file://" + tempfile.mkdtemp(prefix="panelspark-llm-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session that names none gets a new scratch folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _scratch()
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, and a lost
    executor re-reads it instead of replaying what lies before."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normal_line(line: Column) -> Column:
    """Lower case, digit runs as ``0``, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), f"{SPACE}+", " "), r"\d+", "0"))


#: The same in DuckDB SQL, for the line in ``{}``.
NORMAL_LINE_SQL = r"trim(regexp_replace(regexp_replace(lower({}), '[\x20\x09-\x0D]+', ' ', 'g'), '\d+', '0', 'g'))"


def words_of(text: Column) -> Column:
    """Words ``[^\x20\x09-\x0D]+`` of a text."""
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")
