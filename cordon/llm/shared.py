"""What several operators share: tables in the shared folder, text keys, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id where ids are ordered.
NULL_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # the warehouse is shared too, where there is a cluster
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows that a Python worker is sent at once, so that a batch of texts stays small beside the worker itself.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Has Spark send Python workers BATCH_ROWS rows at once, or fewer if the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: later plans restart from files, not from lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cordon_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that no later plan reads, and lets Spark drop the shuffle files of the plans that made them."""
    for t in tables:
        path = getattr(t, "_cordon_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files go once the driver's JVM has dropped the plans that wrote them; this asks for it between stages."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def runtime_filter(spark: SparkSession, rows: int) -> Iterator[None]:
    """Joins that run in here and need a shuffle leave out rows without a partner before it, by a Bloom filter over
    about `rows` rows of the smaller side. The filter's size has Spark's bound (8 MB); beyond it more rows pass."""
    names = "spark.sql.optimizer.runtime.bloomFilter."
    own = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t", "expectedNumItems": str(max(rows, 1000)), "maxNumItems": "1000000000"}
    before = {k: spark.conf.get(names + k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(names + k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(names + k) if v is None else spark.conf.set(names + k, v)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the fast built-in, which is the same for them."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def positions(df: DataFrame, order: list[str], name: str, keep: list[str]) -> DataFrame:
    """df's columns `keep` with row_no, 0.. in the total order of `order`.

    A range shuffle with every order column (so one hot key is cut too), a sort inside each range and one
    small count per range; no single task sees all rows. The sorted rows are written, for range bounds are
    sampled and must not be drawn again.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = [F.col(c) for c in order]
    rows = df.select(*dict.fromkeys([*keep, *order])).repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
    rows = table(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    # one row per range, as many as there are shuffle partitions
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*keep, (F.col("_start") + within).alias("row_no"))
    out._cordon_path = rows._cordon_path  # it is read from there, until it is discarded
    return out


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(v, component) for each vertex of the edges; component is the smallest vertex that it reaches.

    Minimum labels go along edges, then each label jumps to its own label, until none changes. Each round is
    joins and map-side combined minima over ids, written to the shared folder; nothing is collected. A hot
    vertex is one row after the combine; on the join side AQE splits it.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = table(both.union(both.select("dst", "src")).distinct(), "cc-edges")
    labels = table(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("l")).withColumnRenamed("src", "v"), "cc-labels")
    none = F.lit(None).cast("long")
    while True:
        along = both.join(labels, both.dst == labels.v).select(both.src.alias("v"), "l", none.alias("old"))
        best = along.union(labels.select("v", "l", F.col("l").alias("old"))).groupBy("v").agg(F.min("l").alias("l"), F.min("old").alias("old"))
        up = best.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        after = table(best.join(up, "l").select("v", F.least("l", "ll").alias("l"), "old"), "cc-labels")
        changed = after.where("l <> old").limit(1).count()
        discard(labels)
        labels = after
        if not changed:
            discard(both)
            return labels.select("v", F.col("l").alias("component"))
