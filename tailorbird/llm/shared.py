"""What several operators of this subpackage need: shared scratch tables and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scratch: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, one of our own, on local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """The same; then the scratch tables from number `since` on go. For a result that is all that is still needed of them."""
    out = written(df, name)
    last = _scratch.pop()
    clear_scratch(df.sparkSession, since)
    _scratch.append(last)
    return out


def scratch_tables() -> int:
    """How many scratch tables of this process there are."""
    return len(_scratch)


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch tables of this process from number `since` on; call it once no result is read from them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_scratch) > since:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def map_rows(df: DataFrame, f: Callable[[list[list]], Iterator[list]], schema: str) -> DataFrame:
    """mapInArrow with batches as lists of column values; f yields columns in the schema's order.

    A batch of long texts is cut by bytes, so f's own memory is bounded however long the texts are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for batch in batches:
            for part in cut(batch):
                for columns in f([c.to_pylist() for c in part.columns]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)
        pa.default_memory_pool().release_unused()  # workers live on, and stages after this one want the room

    return df.mapInArrow(run, target)


def cut(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes; a single larger row stays whole."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod4(doc_id) -> "F.Column":
    """crc32 of a document id's digits, modulo 4: 2 marks the held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))
