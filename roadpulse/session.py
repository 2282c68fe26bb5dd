"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the reports rely on: zone-less timestamps are compared and printed
# in UTC, AQE coalesces the small post-aggregation shuffles.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Heap of the single JVM of a local session (scripts, tests, bench); takes
# effect when the session starts the JVM.
LOCAL_DRIVER_MEMORY = "8g"

# Sizing for the target scale (hundreds of TB on ~1000 executors). Applied by
# ``build_session(cluster=True)`` only where the cluster sets nothing itself.
CLUSTER_CONF = {
    # The segment aggregate (hotspots, map) shuffles one partial row per
    # segment and map task, hundreds of GB at full scale, while the calendar
    # reports shuffle a few KB. Start every shuffle wide and let AQE merge
    # reduce partitions to the advisory size.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # Reports read two to five narrow columns of each split; larger splits
    # mean fewer tasks and more rows per segment in each partial aggregate.
    "spark.sql.files.maxPartitionBytes": "512m",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app: str = "roadpulse",
    cluster: bool = False,
) -> SparkSession:
    """A session for scripts and tests. On a cluster, the cluster's own
    settings (master, checkpoint folder, memory) are left as they are;
    ``cluster=True`` adds ``CLUSTER_CONF`` for keys the cluster leaves unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local") and not os.environ.get("SPARK_DRIVER_MEMORY"):
            # In local mode every task runs in the driver JVM; Spark's 1 GB
            # default heap leaves eight task threads in constant GC.
            b = b.config("spark.driver.memory", LOCAL_DRIVER_MEMORY)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    configure(spark)
    if cluster:
        for k, v in CLUSTER_CONF.items():
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
    return spark


# Where ``override`` keeps what a setting was before.
SAVED = "roadpulse.saved."


def configure(spark: SparkSession) -> SparkSession:
    """The reports' settings; what ``override`` changed is as it was before."""
    restore(spark)
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def override(spark: SparkSession, settings: dict) -> None:
    """Settings for a kind of work, until the next ``restore``."""
    for k, v in settings.items():
        if spark.conf.get(SAVED + k, None) is None:
            old = spark.conf.get(k, None)
            spark.conf.set(SAVED + k, "unset" if old is None else f"was {old}")
        spark.conf.set(k, v)


def restore(spark: SparkSession) -> None:
    for k, v in dict(spark.conf.getAll).items():
        if k.startswith(SAVED):
            name = k.removeprefix(SAVED)
            spark.conf.unset(name) if v == "unset" else spark.conf.set(name, v.removeprefix("was "))
            spark.conf.unset(k)


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder is read from the session (``spark.checkpoint.dir`` or the
    context's checkpoint directory); only a bare local session gets a temporary
    one (``ensure_checkpoint_dir``).
    """
    base = ensure_checkpoint_dir(spark)
    leaf = f"{name or 'scratch'}-{uuid.uuid4().hex[:12]}"
    return f"{base.rstrip('/')}/{leaf}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session that names none (bare
    tests) gets a temporary one; elsewhere a folder on the driver's machine
    would be out of the executors' sight, so that is an error."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions have no context
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir is not set") from None
        return conf_dir
    d = sc.getCheckpointDir()
    if d:
        return d
    if not conf_dir and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(conf_dir or tempfile.mkdtemp(prefix="roadpulse-ckpt-"))
    return sc.getCheckpointDir()


__all__ = ["build_session", "configure", "override", "restore", "scratch_dir", "ensure_checkpoint_dir"]
