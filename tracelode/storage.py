"""Tables that end lineage: written once to the folder that driver and executors share."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each context: Python workers import its modules by name."""
    context = spark.sparkContext
    if getattr(context, "_tracelode_shipped", False):
        return
    root = Path(__file__).parent
    with zipfile.ZipFile(Path(tempfile.mkdtemp()) / "tracelode_package.zip", "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(z.filename)
    context._tracelode_shipped = True


def spread(df: DataFrame, each: int = 1) -> DataFrame:
    """A table of fewer splits than `each` for every core dealt to so many; any larger one as it is. For work that costs far more than reading."""
    tasks = each * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master gets a temporary folder and any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_TEMPORARY: ContextVar[list[str] | None] = ContextVar("_TEMPORARY", default=None)


def stored(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends and lost executors cost nothing.

    Inside temporaries() the table goes when the block ends, unless it is to be kept.
    """
    path = new_path(df.sparkSession, what)
    held = _TEMPORARY.get()
    if held is not None and not keep:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that stored() wrote in this block when it ends: what it returns has to be stored with keep. Blocks may lie in each other."""
    token = _TEMPORARY.set(held := [])
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        for path in held:
            delete(spark, path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing will read again."""
    for folder in {p.rpartition("/")[0] for p in df.inputFiles()}:
        delete(df.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver's JVM notice that shuffles of finished steps are read by nothing, so that their files leave the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


_MANIFEST = "manifest.json"


def save(df: DataFrame, path: str, settings: str = "") -> None:
    """Writes an artefact: the rows to a folder of their own, then a manifest (folder, schema, rows, settings) that makes it the artefact by one renaming.

    Whoever reads sees the old artefact or the new one, never a part of one; writers at the same time do not disturb each other, the last one counts, and the
    rows of the others go. A writer that is lost leaves a folder that nothing names; the next one that finishes deletes it.
    """
    spark = df.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/{data}").count()
    text = json.dumps({"data": data, "schema": df.schema.json(), "rows": rows, "settings": settings})
    jvm = spark._jvm
    root, made, final = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}/{_MANIFEST}-{data}", f"{path}/{_MANIFEST}"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(made), context.makeQualified(final), overwrite)
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("data-") and name != data:
            system.delete(status.getPath(), True)


def load(spark: SparkSession, path: str, settings: str = "") -> DataFrame | None:
    """The artefact at a path, or None where there is none; one that was made with other settings, or has lost rows, is an error."""
    if not exists(spark, f"{path}/{_MANIFEST}"):
        return None
    m = json.loads(spark.read.text(f"{path}/{_MANIFEST}", wholetext=True).first()[0])
    if m["settings"] != settings:
        raise ValueError(f"{path} was made with other settings: {m['settings']!r}")
    out = spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{path}/{m['data']}")
    if (rows := out.count()) != m["rows"]:
        raise ValueError(f"{path} has {rows} rows, not {m['rows']}")
    return out


_PLACE, _PART = "_place", "_part"


def ranged(df: DataFrame, *order) -> DataFrame:
    """df sorted across partitions, with the partition and the place in it as columns that later jobs can rely on."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(_PLACE, F.monotonically_increasing_id())
    # monotonically_increasing_id() is the partition times 2**33 plus the row's place; writing the table fixes it
    placed = placed.withColumn(_PART, F.shiftright(_PLACE, 33).cast("int")).withColumn(_PLACE, F.col(_PLACE).bitwiseAND((1 << 33) - 1))
    return stored(placed, "ranged")


def dense_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 0, without bringing the rows into one partition."""
    rows = ranged(df, *order)
    sizes = rows.groupBy(_PART).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(_PART), before.alias("_before"))  # a row for each partition
    out = rows.join(F.broadcast(starts), _PART)
    return out.withColumn(name, (F.col("_before") + F.col(_PLACE)).cast("long")).drop(_PART, _PLACE, "_before")


def nth(df: DataFrame, column: str, n: int):
    """The value of a column that stands at place n (from 0) of its order; None beyond the last. The driver gets a count for each partition."""
    rows = ranged(df.select(column), F.col(column))
    for part in sorted(rows.groupBy(_PART).agg(F.count("*").alias("size")).collect(), key=lambda r: r[_PART]):
        if n < part["size"]:
            return rows.where((F.col(_PART) == part[_PART]) & (F.col(_PLACE) == n)).first()[column]
        n -= part["size"]
    return None


def running_sums(df: DataFrame, order: list, sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds running sums (new name: column) over all rows of a group in a total order: sums by partition, then within each. Without `by` all rows are a group."""
    rows = ranged(df, *[F.col(b) for b in by], *order)
    whole = rows.groupBy(_PART, *by).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(_PART, *by, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in sums])  # a row for each partition and each group
    within = Window.partitionBy(_PART, *by).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(starts), [_PART, *by])
    for n, c in sums.items():
        out = out.withColumn(n, (F.col(f"_from_{n}") + F.sum(c).over(within)).cast("long"))
    return out.drop(_PART, _PLACE, *[f"_from_{n}" for n in sums])
