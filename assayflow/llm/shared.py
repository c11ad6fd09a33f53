"""What the operators of this subpackage share: the shared folder, materialised tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: White space that separates words everywhere in this subpackage, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
#: Rows up to which a side may be broadcast; beyond it the join is left to the planner.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine; a cluster without
    the setting is an error, as executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="assayflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/assayflow/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder made under ``new_folder`` that nothing reads any more; one that is not there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Removes the files behind a table made by ``materialised`` that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def whole_number(docs: DataFrame, column: str) -> None:
    """Refuses a column of another type than whole numbers."""
    if not isinstance(docs.schema[column].dataType, IntegralType):
        raise ValueError(f"{column} must be a whole number, not {docs.schema[column].dataType.simpleString()}")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for a broadcast only after counting that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are one of ``chars``."""
    rest = text
    for char in chars:
        rest = F.replace(rest, F.lit(char), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")
