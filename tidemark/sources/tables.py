"""Reading inputs, and storing derived tables, features, means and models."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as schemas
from ..operators.sweep import CHUNK, with_chunk

Build = Callable[[], DataFrame]


def read_input(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """One of the input tables, from Parquet with its declared schema or from the catalog."""
    if path is None:
        return spark.table(name)
    return spark.read.schema(schemas.INPUTS[name]).parquet(path)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:t)", args={"t": name})


def empty_like(spark: SparkSession, name: str) -> DataFrame:
    """Columns of a stored table without rows."""
    return spark.table(name).limit(0)


def ensure_table(spark: SparkSession, name: str, build: Build, rebuild: bool = False,
                 partition_by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Create a derived table if it is absent (or on request) and read it.

    ``path`` places its files outside the warehouse.
    """
    if rebuild or not table_exists(spark, name):
        # Built in a table of its own first: a build that fails leaves the old one alone.
        fresh = f"{name}_{uuid.uuid4().hex}"
        writer = build().write.partitionBy(*partition_by)
        (writer.option("path", path) if path else writer).saveAsTable(fresh)
        drop_table(spark, name)
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    return spark.table(name)


def create_from_sql(spark: SparkSession, name: str, query: str,
                    args: Mapping[str, object] | None = None, rebuild: bool = False) -> DataFrame:
    """Create a table from a parameterised query and read it."""
    return ensure_table(spark, name, lambda: query_with(spark, query, args), rebuild)


def query_with(spark: SparkSession, query: str,
               args: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL with ``:named`` markers; ``IDENTIFIER(:t)`` takes a table name."""
    return spark.sql(query, args=dict(args or {}))


def _file_exists(spark: SparkSession, path: str) -> bool:
    """Ask the path's own file system, whichever that is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def finished(spark: SparkSession, folder: str) -> bool:
    """Does the folder hold a whole result?  A write sets its marker when all parts are there."""
    return _file_exists(spark, f"{folder.rstrip('/')}/_SUCCESS")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when a file below the paths is added, removed, resized or written again.

    Only the listing is read.  Hidden files don't count.
    """
    conf, digest = spark._jsc.hadoopConfiguration(), hashlib.sha256()
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files, seen = root.getFileSystem(conf).listFiles(root, True), []
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if not name.rsplit("/", 1)[-1].startswith((".", "_")):
                seen.append((name, f.getLen(), f.getModificationTime()))
        digest.update(json.dumps(sorted(seen)).encode())
    return digest.hexdigest()


def cache_path(spark: SparkSession, folder: str, name: str, params: Mapping[str, object],
               inputs: Sequence[str] = ()) -> str:
    """Folder of a stored result; the key covers every parameter and the files of ``inputs``."""
    known = {**params, "_inputs": fingerprint(spark, *inputs)} if inputs else dict(params)
    key = hashlib.sha256(json.dumps(known, sort_keys=True, default=str).encode())
    return f"{folder.rstrip('/')}/{name}-{key.hexdigest()[:16]}"


def cached(spark: SparkSession, folder: str, name: str, params: Mapping[str, object],
           build: Build, inputs: Sequence[str] = ()) -> DataFrame:
    """Stored result if there is one for these parameters and input files, else build and store.

    ``inputs`` are the paths that ``build`` reads: a result of changed files isn't used.  The
    result is written in a folder of its own and then renamed, so that readers and other
    builders never see parts of two builds; if another one was faster, its result is taken.
    An empty name computes without storing.
    """
    if not name:
        return build()
    path = cache_path(spark, folder, name, params, inputs)
    if not finished(spark, path):
        fresh = f"{path}-{uuid.uuid4().hex}"
        build().write.parquet(fresh)
        _publish(spark, fresh, path)
    return spark.read.parquet(path)


def _publish(spark: SparkSession, fresh: str, path: str) -> None:
    """Give a finished folder its name; an unfinished one in its place goes first."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not finished(spark, path):
        fs.delete(target, True)
    # A rename onto a folder would move into it, so the name is checked first and after.
    if not fs.exists(target) and fs.rename(source, target):
        return
    if not finished(spark, path):
        raise OSError(f"can't publish {path}")
    fs.delete(source, True)


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    """Prefix and zero-padded number; longer numbers are kept whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0"))
                    .otherwise(text))


def write_by_bucket(df: DataFrame, path: str, entity: str, buckets: int = 256,
                    files_per_bucket: int = 8, mode: str = "overwrite") -> None:
    """One table for all entities, partitioned by a hash bucket of the entity.

    A reader of one entity prunes to its bucket.  Each bucket is written by
    ``files_per_bucket`` tasks, so neither a long entity nor many small files
    come of it; raise the number where one entity holds much of the data.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_bucket))
    (df.withColumn("bucket", bucket_of(F.col(entity), buckets)).withColumn("_part", part)
     .repartition("bucket", "_part").drop("_part")
     .write.mode(mode).partitionBy("bucket").parquet(path))


def bucket_of(entity: Column, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def read_entity(spark: SparkSession, path: str, entity: str, value, buckets: int = 256) -> DataFrame:
    """Rows of one entity, reading only its bucket."""
    typed = F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value)
    return spark.read.parquet(path).filter(
        (F.col("bucket") == bucket_of(typed, buckets)) & (F.col(entity) == typed)).drop("bucket")


def write_clustered(df: DataFrame, name: str, path: str, entity: Sequence[str], ts: str,
                    chunk_hours: float = 24.0, buckets: int = 64) -> DataFrame:
    """A table bucketed by entity and time chunk and sorted by time in its buckets; read back.

    Windows, aggregates and joins by entity and chunk, as in ``operators.sweep``, then need
    no shuffle of these rows, however often they are read.  An entity is spread over the
    buckets by its chunks.  The rows are shuffled once here; ``buckets`` sets their tasks.
    """
    keys = [*entity, CHUNK]
    rows = with_chunk(df, ts, chunk_hours).repartition(buckets, *keys)
    (rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, ts)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def save_table(df: DataFrame, path: str) -> None:
    """Store a feature or means table."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored feature or means table, or None where there is none."""
    return spark.read.parquet(path) if finished(spark, path) else None


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """A stored model, or None where there is none; a damaged one is an error."""
    spark = SparkSession.getActiveSession()
    return PipelineModel.load(path) if _file_exists(spark, path) else None


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item dimension from CSV; quoted fields may hold commas."""
    return spark.read.csv(path, header=True, quote='"', escape='"', schema=schemas.ITEMS,
                          enforceSchema=True)
