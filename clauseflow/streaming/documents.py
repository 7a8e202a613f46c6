"""Streams over newly arrived documents and results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseflow.operators.windows import latest_per_key


def arrivals(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive; the stream checkpoint remembers which were seen."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def drain(query: StreamingQuery) -> None:
    """Wait for an available-now query and surface its error."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def check_incrementally(
    stream: DataFrame, stateless: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Apply a stateless projection to each new document exactly once."""
    return (
        stateless(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def disk_backed_state(spark: SparkSession) -> None:
    """State of streams started from now on lives on the executors' disks, with its changes in the
    checkpoint, so that it is bounded by disk and not by heap. A provider already chosen stays."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, None) or ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def suppress_duplicates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First occurrence of each content key, whenever the others arrive.

    Content keys have no event time, so nothing is late and no key is forgotten; the state is
    the set of keys, partitioned by their hash, in a disk-backed store.
    """
    disk_backed_state(stream.sparkSession)
    return stream.select(*keys).dropDuplicates(keys)


# ------------------------------------------------------------------ latest record per key
def _committed(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind``-n of a table whose write was committed."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[len(kind) + 1 :]) for n in done if n.startswith(kind + "-"))


def _versions(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """(folders that hold the current versions, last batch among them)."""
    bases, batches = _committed(spark, table, "base"), _committed(spark, table, "batch")
    base = bases[-1] if bases else -1
    folders = [f"{table}/base-{base}"] if bases else []
    later = [b for b in batches if b > base]
    return folders + [f"{table}/batch-{b}" for b in later], max([base, *later])


def upsert_latest(
    stream: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str
) -> StreamingQuery:
    """Append each micro-batch's latest record per key as a version of its own.

    Nothing that is there is rewritten. A batch is a folder named by its number: one that is
    replayed replaces itself, and one whose write was cut off is not read.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{table}/batch-{batch_id}")

    return (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> DataFrame | None:
    """The latest record per key over all versions; None for a table without any."""
    folders, _ = _versions(spark, table)
    return latest_per_key(spark.read.parquet(*folders), keys, order) if folders else None


def compact_latest(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> None:
    """Fold all versions so far into one, beside the stream and apart from it.

    Readers take the last base that was committed and the batches after it; folders that a base
    has made needless can be removed once no reader uses them.
    """
    folders, last = _versions(spark, table)
    if len(folders) > 1:
        latest_per_key(spark.read.parquet(*folders), keys, order).write.mode("overwrite").parquet(
            f"{table}/base-{last}"
        )


# ------------------------------------------------------------------ running gate
def gate_log(spark: SparkSession, store: str, minimum: int = 30) -> DataFrame:
    """(batch, n_seen, n_positive, stop) from the stored counts of the batches."""
    batches = _committed(spark, store, "batch")
    if not batches:
        return spark.createDataFrame([], "batch long, n_seen long, n_positive long, stop boolean")
    counts = spark.read.parquet(*[f"{store}/batch-{b}" for b in batches])
    # one row a batch
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select("batch", F.sum("n").over(upto).alias("n_seen"), F.sum("p").over(upto).alias("n_positive"))
    one_sided = (F.col("n_positive") == 0) | (F.col("n_positive") == F.col("n_seen"))
    return sums.withColumn("stop", (F.col("n_seen") >= minimum) & one_sided)


def gated(
    stream: DataFrame, prediction: str, positive: str, checkpoint: str, minimum: int = 30
) -> list[dict]:
    """Run until the outputs so far are one-sided: at least ``minimum`` rows of one class.

    Each micro-batch is reduced to two counts, stored under its number beside the checkpoint. The
    gate is judged from the stored counts, so a restart goes on where the last run ended, and a
    replayed batch counts once. Returns the gate log up to the batch that stopped the run.
    """
    spark, store = stream.sparkSession, f"{checkpoint}-gate"

    def stopped() -> bool:
        return bool(gate_log(spark, store, minimum).where("stop").head(1))

    def observe(batch: DataFrame, batch_id: int) -> None:
        batch.agg(
            F.lit(batch_id).cast("long").alias("batch"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(prediction) == positive).alias("p"),
        ).write.mode("overwrite").parquet(f"{store}/batch-{batch_id}")
        if stopped():
            raise _Stop

    if not stopped():
        query = (
            stream.writeStream.foreachBatch(observe).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not stopped():
                raise
    log = [r.asDict() for r in gate_log(spark, store, minimum).orderBy("batch").collect()]
    end = next((i for i, r in enumerate(log) if r["stop"]), len(log) - 1)
    return log[: end + 1]


class _Stop(Exception):
    """Ends a gated stream after the batch that closed its gate."""
