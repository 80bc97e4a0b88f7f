"""Session settings the operators are written for."""

from pyspark.sql import SparkSession

#: The JVM never compiles methods over 8000 bytes and runs them byte by byte; below it Spark splits wide projections instead.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000
#: Shuffle files go when the query that wrote them ends; else they stay until the driver's garbage collector finds their frames.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tuned(spark: SparkSession) -> SparkSession:
    """A session made elsewhere, with the settings that the operators need; a lower limit stays."""
    if int(spark.conf.get(HUGE_METHOD)) > COMPILED_BYTES:
        spark.conf.set(HUGE_METHOD, COMPILED_BYTES)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    return spark


def build_session(app: str = "finfacts", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the master comes from
    spark-submit and adaptive execution sizes the shuffles.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        HUGE_METHOD: str(COMPILED_BYTES),
        SHUFFLE_CLEANUP: "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
