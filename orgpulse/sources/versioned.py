"""Tables of immutable Parquet files whose versions are published in one step.

    <path>/data/<commit>/      files of one commit, never changed
    <path>/manifests/<commit>/ the version's files with their least and greatest key and their rows, as Parquet
    <path>/versions/<number>   the name of the version's manifest

A version is there once its small file in ``versions`` is: it is written aside and renamed, which is
one step and fails if the number is taken. A writer that ends before leaves files that nothing refers
to, and the version before stays readable. Two writers of the same version can't both publish it.

Files hold ranges of keys. An upsert compares the ranges of its batch with those of the files and
rewrites only files that can hold one of its keys; the others are carried on by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.operators.ordered import latest_per_key

# Rows a file, and ranges that a batch's keys are summed up in to find the files they may be in.
FILE_ROWS = 1_000_000
BATCH_RANGES = 64


class TakenError(RuntimeError):
    """Another writer has published this version of a table."""


def _folder(spark: SparkSession, path: str):
    """Hadoop's file context and path class, for the few steps that aren't reads or writes of frames."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    return context, jvm.org.apache.hadoop.fs


def _versions(spark: SparkSession, path: str) -> list[int]:
    context, fs = _folder(spark, path)
    folder = fs.Path(f"{path}/versions")
    if not context.util().exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in context.util().listStatus(folder) if f.getPath().getName().isdigit())


def version(spark: SparkSession, path: str) -> int:
    """Number of the newest version of a table, 0 if there is none."""
    return max(_versions(spark, path), default=0)


def _publish(spark: SparkSession, path: str, number: int, commit: str) -> None:
    context, fs = _folder(spark, path)
    aside, final = fs.Path(f"{path}/versions/_{commit}"), fs.Path(f"{path}/versions/{number}")
    spark.createDataFrame([(commit,)], "commit string").coalesce(1).write.text(f"{path}/versions/_{commit}.d")
    written = [f.getPath() for f in context.util().listStatus(fs.Path(f"{path}/versions/_{commit}.d")) if f.getPath().getName().startswith("part-")]
    none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    context.rename(written[0], aside, none)
    try:
        context.rename(aside, final, none)
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            raise TakenError(f"version {number} of {path} is taken") from error
        raise


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """Files of a version (the newest, if not given): file, low, high (structs of the key columns) and n_rows."""
    number = version(spark, path) if number is None else number
    if not number:
        return None
    commit = spark.read.text(f"{path}/versions/{number}").first().value
    return spark.read.parquet(f"{path}/manifests/{commit}")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version of a table, the newest if not given."""
    files = manifest(spark, path, number)
    if files is None:
        raise FileNotFoundError(f"no version of {path}")
    return _rows(spark, path, files)


def _rows(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Rows of a manifest's files. Their names go to the driver, as those of any table that Spark reads."""
    names = [r.file for r in files.select("file").collect()]
    if not names:
        return spark.read.parquet(f"{path}/data/*").where(F.lit(False))
    return spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).parquet(*[f"{path}/data/{n}" for n in names])


def _ranges(rows: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """Least and greatest key and number of rows for each value of ``by``."""
    key = F.struct(*keys)
    return rows.groupBy(by.alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n_rows"))


def commit(rows: DataFrame, path: str, keys: Sequence[str], after: int, carried: DataFrame | None = None, n_files: int | None = None) -> int:
    """Publish ``rows`` and the files ``carried`` on as the version that follows ``after``; its number."""
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    # Counting, drawing the ranges and writing each need the rows; they are folded once.
    rows = rows.persist()
    try:
        if n_files is None:
            n_files = max(1, -(-rows.count() // FILE_ROWS))
        rows.repartitionByRange(n_files, *keys).write.parquet(f"{path}/data/{name}")
    finally:
        rows.unpersist()
    own = spark.read.parquet(f"{path}/data/{name}")
    file = F.concat(F.lit(f"{name}/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    files = _ranges(own, keys, file)
    if carried is not None:
        files = files.unionByName(carried.select(*files.columns))
    files.coalesce(1).write.parquet(f"{path}/manifests/{name}")
    _publish(spark, path, after + 1, name)
    return after + 1


def replace(rows: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Publish a version of just these rows."""
    return commit(rows, path, keys, version(rows.sparkSession, path))


def touched_files(batch: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files of a manifest whose range of keys meets one of the batch's. ``keys`` are the table's, or the first of them.

    The batch's keys are summed up in up to BATCH_RANGES ranges, so the comparison is of files with
    so many ranges, whatever the batch holds.
    """
    ranges = batch.select(*keys).repartitionByRange(BATCH_RANGES, *keys).groupBy(F.spark_partition_id().alias("part"))
    key = F.struct(*keys)
    ranges = ranges.agg(F.min(key).alias("first"), F.max(key).alias("last")).select("first", "last")
    low, high = (F.struct(*[F.col(f"{side}.{k}").alias(k) for k in keys]) for side in ("low", "high"))
    return files.join(F.broadcast(ranges), (low <= F.col("last")) & (high >= F.col("first")), "left_semi")


def replace_groups(rows: DataFrame, path: str, keys: Sequence[str], groups: DataFrame) -> int:
    """Publish a version in which ``rows`` stand in place of all stored rows of ``groups``.

    The columns of ``groups`` are the first of ``keys`` (for example the day), so files without one of
    the groups are carried on. A group without rows is empty afterwards.
    """
    spark = rows.sparkSession
    after = version(spark, path)
    files = manifest(spark, path, after)
    if files is None:
        return commit(rows, path, keys, after)
    lead = list(keys[: len(groups.columns)])
    named = groups.select(*lead).distinct()
    found = touched_files(named, files, lead).select("file", "n_rows").collect()
    if not found:
        return commit(rows, path, keys, after, files)
    touched = spark.createDataFrame([(r.file,) for r in found], "file string")
    stored = _rows(spark, path, touched)
    marked = named.select(*[F.col(c).alias(f"_{c}") for c in lead])
    same = F.lit(True)
    for c in lead:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    kept = stored.join(marked, same, "left_anti")
    return commit(kept.unionByName(rows, allowMissingColumns=True), path, keys, after, files.join(touched, "file", "left_anti"), len(found))


def upsert(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column | str], attempts: int = 5) -> int:
    """Publish a version in which the batch's rows replace stored ones of the same key; newest by ``order`` wins.

    Running a batch twice gives the same rows. If another writer publishes first, the batch is
    merged again with what it wrote.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        for _ in range(attempts - 1):
            try:
                return _merge(spark, batch, path, keys, order)
            except TakenError:
                continue
        return _merge(spark, batch, path, keys, order)
    finally:
        batch.unpersist()


def _merge(spark: SparkSession, batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column | str]) -> int:
    after = version(spark, path)
    files = manifest(spark, path, after)
    if files is None:
        return commit(latest_per_key(batch, keys, order), path, keys, after)
    # Names of files go to the driver, as those of any table that Spark reads.
    found = touched_files(batch, files, keys).select("file", "n_rows").collect()
    touched = spark.createDataFrame([(r.file,) for r in found], "file string")
    rows = _rows(spark, path, touched).unionByName(batch, allowMissingColumns=True) if found else batch
    carried = files.join(touched, "file", "left_anti")
    n_files = max(len(found), 1, -(-(sum(r.n_rows for r in found) + batch.count()) // FILE_ROWS))
    return commit(latest_per_key(rows, keys, order), path, keys, after, carried, n_files)


def drop_versions(spark: SparkSession, path: str, keep: int) -> int:
    """Forget all but the newest ``keep`` versions and delete data that none of those refers to; how many are forgotten.

    Only for a table that nobody writes or reads an old version of meanwhile.
    """
    numbers = _versions(spark, path)
    old = numbers[: max(0, len(numbers) - keep)]
    if not old:
        return 0
    context, fs = _folder(spark, path)
    names = {spark.read.text(f"{path}/versions/{n}").first().value: n for n in numbers}
    kept = [manifest(spark, path, n).select(F.split_part("file", F.lit("/"), F.lit(1)).alias("commit")) for n in numbers if n not in old]
    used = kept[0]
    for more in kept[1:]:
        used = used.union(more)
    used = {r.commit for r in used.distinct().collect()}
    for n in old:
        context.delete(fs.Path(f"{path}/versions/{n}"), False)
    for name, n in names.items():
        if n in old:
            context.delete(fs.Path(f"{path}/manifests/{name}"), True)
        if name not in used:
            context.delete(fs.Path(f"{path}/data/{name}"), True)
    return len(old)
