"""Session helpers: a tuned local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, app: str = "treeloom") -> SparkSession:
    """Session used by tests and bench. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TREELOOM_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names storage every executor can reach; it is read,
    never replaced. Only when it is unset (local tests) a private folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="treeloom-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``treeloom`` importable in Python workers (executors) via ``addPyFile``.

    Operators with Arrow-batched Python steps (parsing blueprints, compiling
    ignore rules, BPE, the file-tree source, the scaffold writer) call this; it
    zips the package once per process and ships it once per SparkContext.
    """
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        out_dir = os.path.join("/" + base[5:].lstrip("/"), f"treeloom-py-{key}")
        os.makedirs(out_dir, exist_ok=True)
    else:  # non-POSIX shared store: the archive only needs to exist on the driver, Spark ships it
        out_dir = tempfile.mkdtemp(prefix="treeloom-py-")
    archive = shutil.make_archive(os.path.join(out_dir, "treeloom"), "zip", os.path.dirname(pkg_dir), "treeloom")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


_COLUMN_MEMO: dict = {}


def memo_columns(key, build):
    """Reuse Column expressions built by ``build()`` for the active SparkContext.

    Large expression trees (inspection, markers, notebook rendering, path rules)
    cost thousands of JVM round trips to build; they only name columns, so one
    build per application and option set serves every query.
    """
    active = SparkSession.getActiveSession()
    app = active.sparkContext.applicationId if active is not None else None
    k = (app, key)
    if k not in _COLUMN_MEMO:
        _COLUMN_MEMO[k] = build()
    return _COLUMN_MEMO[k]
