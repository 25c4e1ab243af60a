"""Session helpers: configuration, shared scratch folder and written hand-off tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_HANDOFFS: dict[tuple[str, str], str] = {}

#: Rows a bucket of a bucketed hand-off at least holds: a row of a series becomes hundreds in what follows.
BUCKET_ROWS = 512


def build_session(app: str = "tidecast", cpus: str = "*", shuffle_partitions: int | None = None,
                  memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster spark-submit supplies the settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        # percentile and collect_list groups are calendar-sized, so far more of them fit in the hash map
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a local one in local mode only."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tidecast-")
    return _LOCAL_SCRATCH[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder; never reused, so concurrent runs cannot collide."""
    return os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")


def fingerprint(spark: SparkSession, folder: str) -> str:
    """A short name for the present content of a folder: paths, sizes and times of its files, as the file system lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    lines = []
    while found.hasNext():
        f = found.next()
        lines.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()[:16]


def handoff(spark: SparkSession, key: str, build, partition_by: list[str] | None = None, source: str | None = None,
            bucket_by: str | None = None) -> DataFrame:
    """Write a stage's result once per application and state of its input folder ``source``, and read it back.

    Stages hand over written Parquet rather than a long lineage: a lost executor re-reads files
    instead of recomputing the forecasts, and the next stage gets column and partition pruning. A rewritten input has
    another fingerprint, so that what was built from the old one is not used again. With ``bucket_by`` the table is
    bucketed, so that windows, aggregates and joins by that column plan no exchange: into as many parts as a shuffle has,
    or fewer if its rows are few. Spark never merges buckets, and a larger input has more parts a shuffle but not more weeks.
    """
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = key if source is None else f"{key}:{fingerprint(spark, source)}"
    slot = (spark.sparkContext.applicationId, f"{name}:{buckets}" if bucket_by else name)
    if slot not in _HANDOFFS:
        path = new_path(spark, "handoff")
        if bucket_by:
            table = f"handoff_{uuid.uuid4().hex}"
            rows = staged(build(), "handoff-rows")
            buckets = max(1, min(buckets, -(-rows.count() // BUCKET_ROWS)))
            rows = rows.repartition(buckets, bucket_by)
            rows.write.format("parquet").option("path", path).bucketBy(buckets, bucket_by).saveAsTable(table)
            _HANDOFFS[slot] = table
        else:
            writer = build().write
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            _HANDOFFS[slot] = path
    return spark.table(_HANDOFFS[slot]) if bucket_by else spark.read.parquet(_HANDOFFS[slot])


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh path below the scratch folder and read it back, with its partition numbers settled."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
