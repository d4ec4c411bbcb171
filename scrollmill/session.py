"""Session helpers shared by all operators: table access, task spread, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a side counts as small enough to send to every executor.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` (one file or a folder of files) under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores.

    A large input already has more splits than cores and comes back as it is; only an input of
    few splits (small files, one row group each) is dealt out anew, so that Python work on it
    is not left to one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that `spark.checkpoint.dir` names.

    Where the session names none, as in tests, a local one is made; a cluster whose executors
    would not share it is refused.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "scrollmill-checkpoints"))
    return shared or sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table beside the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(folder: str) -> str:
    """The path under which the file system shows a shared folder; refused where it is no mounted one."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"{folder} is not mounted: transcripts and stores need a folder that every machine shows as a path")
    return folder.removeprefix("file://") if "://" in folder else folder.removeprefix("file:")


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the checkpoint folder and read back, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster: sent once a session."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_scrollmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="scrollmill-"), "scrollmill.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(target)
    sc._scrollmill_shipped = True


def once(df: DataFrame, name: str, value) -> DataFrame:
    """`df` with column `name`, computed once a row.

    The optimizer writes a plain column's expression into every place that reads it; a costly one
    read many times is kept apart from its readers by a generator of one row.
    """
    from pyspark.sql import functions as F

    return df.select("*", F.explode(F.array(value)).alias(name))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of `df` take `most` bytes at most when sent whole; counts them.

    Each field counts 16 bytes and texts their length besides, so the bound holds for plain columns.
    """
    from pyspark.sql import functions as F

    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    n = df.agg(sum(texts, F.count(F.lit(1)) * (16 * len(df.columns))).alias("n")).first()["n"]
    return n <= most


def attach(df: DataFrame, side: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """`df` left-joined with `side`, a written table that has each of `keys` once.

    A side of proven small size is broadcast. Any other is repeated under `salts`, and the rows of
    `df` are dealt over them by column `by`, so that no key gathers its rows in one task.
    """
    from pyspark.sql import functions as F

    if small(side):
        return df.join(F.broadcast(side), keys, "left")
    wide = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(wide, [*keys, "_salt"], "left").drop("_salt")
