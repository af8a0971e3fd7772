"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space: space and tab to carriage return. A word is a longest run of other characters.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch: bounds what a Python worker holds when some texts are very long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset and Spark runs on one
    machine, a folder of this machine; elsewhere executors would write where others cannot read, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders that `cut` has written, with the session that wrote them.
_WRITTEN: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back, so that a lost executor costs a read and no recomputation.
    The result reads the folder, which stays until `discard`, `clean` or the end of the program."""
    path = f"{shared_dir(df.sparkSession)}/gridlake-{uuid.uuid4().hex}"
    _WRITTEN[path] = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark and spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` returned and that nothing will read any more."""
    for t in tables:
        _delete(t.folder)


@atexit.register
def clean() -> None:
    """Deletes all that `cut` has written. Results that were not written or collected before cannot be read any more."""
    for path in list(_WRITTEN):
        _delete(path)


def local_table(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """A small table of the driver whose size Spark knows, so that it broadcasts it only while it is small enough."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    data = [dict(zip(kind.names, r, strict=True)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(kind)), kind)


def boxed(df: DataFrame, columns: list[str]) -> Column:
    """The named columns in one struct, by place, so that they clash with no other names; `unboxed` takes them out."""
    return F.struct(F.lit(None).cast("boolean").alias("c"), *[df[c].alias(f"c{k}") for k, c in enumerate(columns)])


def unboxed(box: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{box}.c{k}").alias(c) for k, c in enumerate(columns)]


#: A key with more than this share of all rows is hot; there are at most 1 / HOT such keys.
HOT = 1 / 2000


def with_looked_up(rows: DataFrame, table: DataFrame, key: str, held: str, total: int) -> DataFrame:
    """`rows`, left joined with `table`: one row for each key, of which `held` counts the rows of `rows`, `total` in all. Rows
    with a hot key are joined with a local table of these keys, at most 1 / HOT, and stay where they are; so no task gets all
    rows of a key. Both tables are read twice and should be written ones."""
    hot = table.where(F.col(held) > max(1000, total * HOT)).collect()
    if not hot:
        return rows.join(table.drop(held), key, "left")
    here = local_table(rows.sparkSession, hot, table.schema).drop(held)
    many = F.col(key).isin([r[key] for r in hot])
    return rows.where(~many | F.col(key).isNull()).join(table.drop(held), key, "left").unionByName(rows.where(many).join(here, key, "left"))


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hex256(text: Column) -> Column:
    return F.sha2(text, 256)
