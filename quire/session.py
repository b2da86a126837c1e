"""Spark session and checkpoint helpers.

Iterative operators (set cover rounds, connected components, pivot
clustering) cut their lineage with ``DataFrame.checkpoint()`` into the
shared folder named by ``spark.checkpoint.dir``.  On a cluster that
setting comes from the job configuration; only when it is unset (local
runs and tests) do we pick a scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoint files of round results nobody references any more are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quire", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if master and master.startswith("local") and not (extra or {}).get("spark.driver.memory"):
        builder = builder.config("spark.driver.memory", "4g")   # local runs: driver = executor
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session (Arrow UDF workers import it)."""
    sc = _context(spark)
    key = sc.applicationId if sc is not None else f"connect-{id(spark)}"
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="quire-pkg-", dir=os.environ.get("TMPDIR", "/tmp"))
    zpath = os.path.join(out_dir, "quire.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(zpath)
    else:
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> SparkSession:
    """Idempotent per-session setup used by every public entry point."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only if unset."""
    sc = _context(spark)
    if sc is None:   # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # Local runs and tests only: the cluster names a shared folder.
        conf_dir = tempfile.mkdtemp(prefix="quire-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, sized: bool = False) -> DataFrame:
    """Reliable checkpoint (survives executor loss), materialised now.

    A checkpoint keeps the size that the optimizer estimated for its plan, and a join's estimate is
    the product of its sides', so over many rounds of joins the estimates grow without bound.
    ``sized`` measures the rows first (held until they are checkpointed), for loops of many
    rounds.

    The shuffles that the rows came from are deleted when they are written, not when the driver next collects garbage:
    the checkpoint replaces them (whoever reads ``df`` itself again has its own)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    classic = _context(spark) is not None
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false") if classic else None
    if classic:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df = df.select("*")                  # a query of its own, planned under this setting
        if not sized:
            return df.checkpoint(eager=True)
        held = df.persist()
        held.count()
        out = held.checkpoint(eager=True)
        held.unpersist()
        return out
    finally:
        if classic:
            spark.conf.set(SHUFFLE_CLEANUP, kept)
