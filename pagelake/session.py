"""Session, table loading, checkpointing and size-checked broadcast helpers."""

from __future__ import annotations

import os
import shlex
import tempfile
import uuid
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Rule tables (domain lists, lexicons, robots rules, query texts) are broadcast
# only when a bounded probe proves they are below this many rows and bytes.
BROADCAST_ROW_LIMIT = 100_000
BROADCAST_BYTES = 64 << 20


def _preset() -> set[str]:
    """Names of the settings that the caller's cluster, submit command or
    running session already has."""
    running = SparkContext._active_spark_context
    if running is not None:
        return {k for k, _ in running.getConf().getAll()}
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit
        SparkContext._ensure_initialized()
        return {k for k, _ in SparkConf().getAll()}
    names, args = set(), shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for flag, value in zip(args, args[1:]):
        if flag == "--conf":
            names.add(value.split("=", 1)[0])
        elif flag == "--driver-memory":
            names.add("spark.driver.memory")
    return names


def build_session(master: str | None = None, app: str = "pagelake", **conf) -> SparkSession:
    """Session with AQE on, UI off and UTC time, sized for local tests.

    Defaults apply only where neither ``conf`` nor the cluster, the submit
    command or a running session has set a value; ``conf`` always applies.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        defaults |= {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    preset = _preset()
    for k, v in {**{k: v for k, v in defaults.items() if k not in preset}, **conf}.items():
        b = b.config(k, str(v))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per
    context: functions that run there are pickled by reference to it."""
    sc = spark.sparkContext
    if getattr(sc, "_pagelake_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="pagelake-ship-"), "pagelake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("pagelake", os.path.relpath(path, home)))
    sc.addPyFile(target)  # the driver serves it; executors fetch their own copy
    sc._pagelake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table (S1).  Parquet scan: filters and projections
    written downstream are pushed into the reader by Catalyst."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local-mode session without the setting (tests) gets a fresh
    temporary folder; on a cluster a missing setting is an error, because a
    machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative jobs")
    path = tempfile.mkdtemp(prefix="pagelake-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never localCheckpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for written tables; it
    goes when the driver's file system closes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def small_enough(df: DataFrame, rows: int, size: int) -> bool:
    """Bounded probe: whether ``df`` has at most ``rows`` rows and about
    ``size`` bytes; it reads at most rows + 1 rows, so it is cheap on big inputs."""
    wide = [F.octet_length(f"`{f.name}`") if f.dataType.typeName() in ("string", "binary") else F.size(f"`{f.name}`") * 64
            for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map")]
    width = sum((F.coalesce(w.cast("long"), F.lit(0)) for w in wide), F.lit(16 * len(df.columns)).cast("long"))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return n <= rows and (held or 0) <= size


def bounded_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its rows and bytes are proven small; otherwise
    leave the join to a shuffle (sort-merge / shuffled-hash chosen by AQE)."""
    limit = BROADCAST_ROW_LIMIT if limit is None else limit
    if limit > 0 and small_enough(df, limit, BROADCAST_BYTES):
        return F.broadcast(df)
    return df
