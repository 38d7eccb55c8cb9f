"""Session settings and reliable lineage cuts."""

import os
import shutil
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

from .sources.folders import shared_root

_SHIPPED = set()
_SETTING = threading.Lock()
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers (once per application), wherever they start."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="spark-"), os.path.basename(package)), "zip",
            os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)  # the driver serves the file; no worker reads the driver's disk
        _SHIPPED.add(context.applicationId)
    return spark


def build_session(app_name="mailgrain", master=None, cores=None):
    """A session with adaptive execution on; `master` is left to spark-submit on a cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("MAILGRAIN_DRIVER_MEMORY", "12g"))
            .config("spark.sql.shuffle.partitions", str(cores or 8))
        )
    return ship_package(builder.getOrCreate())


def _tidy(df: DataFrame) -> DataFrame:
    """`df` as a query of its own whose shuffle files go when it has run; a plan remembers the setting it was made under."""
    conf = df.sparkSession.conf
    with _SETTING:
        before = conf.get(CLEAN_SHUFFLES)
        conf.set(CLEAN_SHUFFLES, "true")
        try:
            return df.select("*")
        finally:
            conf.set(CLEAN_SHUFFLES, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint; the shuffle files behind it go at once, not at the driver's next full collection.

    The shared folder comes from the session (`spark.checkpoint.dir`); only a local session may go without one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return _tidy(df).checkpoint(eager=True)
