"""Writers: each goes through Spark's own commit, so a lost executor leaves no half-written result."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = ("gt_geometry", "gt_box", "center", "dx", "dy", "x", "y", "z")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one the cluster names; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scenova-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a new shared folder: what is read from it stays the same, and its plan begins there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in order within and across part files."""
    write_lines(df.orderBy(*order), path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines in the order of ``df``, packed: their names repeat in every line."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_public_private(df: DataFrame, root: str, public: list[str], key: str = "qa_id") -> None:
    """Two tables, one row each for a key: the public one has the listed columns, which may hold no geometry."""
    if leaked := [c for c in public if c in GEOMETRY]:
        raise ValueError(f"public columns hold geometry: {leaked}")
    doubled = df.groupBy(key).count().where("count > 1").limit(1).count()
    if doubled:
        raise ValueError(f"{key} is not unique")
    df.select(*public).write.mode("overwrite").parquet(f"{root}/public")
    df.select(key, *[c for c in df.columns if c not in public]).write.mode("overwrite").parquet(f"{root}/private")


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_variants(variants: dict[str, DataFrame], path: str) -> None:
    """Variants of one question set as one table with a variant column.

    Variants repeat each other's texts, and ids that follow each other begin alike: they are packed by their common beginnings.
    """
    rows = [df.withColumn("variant", F.lit(name)) for name, df in variants.items()]
    packed = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#a_id": "false", "parquet.enable.dictionary#b_id": "false", "parquet.enable.dictionary#refs.list.element": "false"}
    reduce(DataFrame.unionByName, rows).write.mode("overwrite").partitionBy("variant").options(**packed).parquet(path)


def write_checked(df: DataFrame, path: str) -> int:
    """Write, read again and compare the number of rows."""
    df.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if n != df.count():
        raise ValueError(f"{path} has {n} rows")
    return n


def write_documents(df: DataFrame, root: str) -> int:
    """One file for each row (name, content): a name may have folders. The number of files.

    A task that runs again writes the same names. Names that are not alone would
    overwrite each other, so they end the job.
    """
    if df.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("names of documents are not unique")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                files.create_dir(posixpath.dirname(f"{base}/{name}"), recursive=True)
                with files.open_output_stream(f"{base}/{name}") as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    written = df.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(put, "n bigint")
    return written.agg(F.sum("n")).first()[0] or 0


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report table as text; ``most`` rows at most, since reports are short."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
