"""Stock transactions as a stream, each micro-batch against one snapshot of items and bins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bomwerk.operators.dimensions import Tables
from bomwerk.plans.transactions import checked, snapshot, to_post
from bomwerk.session import folder_exists, run_folder
from bomwerk.sources.schemas import SCHEMAS
from bomwerk.sources.snapshots import SnapshotTables


def read_transactions(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Transactions arriving as parquet files in a folder."""
    return (
        spark.readStream.schema(SCHEMAS["voorraad_transactie"])
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def start_transactions(tables: Tables, transactions: DataFrame, out: str, **trigger) -> StreamingQuery:
    """Check arriving transactions and write ``out/checked`` and ``out/postings``.

    Stateless: each micro-batch is held to one snapshot of ``tables``. With
    ``SnapshotTables`` that is the version that is the latest when the batch is first
    tried, so the stream follows the stock; other tables are taken as they are at the
    start. A snapshot is reduced and stored once, below ``out/snapshot``, and the batch
    records which one it uses before it is judged: repeated after a failure, it is judged
    by the same. Each micro-batch overwrites its own folders and posts from what it wrote,
    so a repeated batch leaves one copy. The static joins are planned per micro-batch,
    adaptively.
    """
    spark = transactions.sparkSession
    started = f"start-{uuid.uuid4().hex}"
    stored: set[str] = set()

    def store(label: str, source: Tables) -> str:
        if label not in stored:
            for name, rows in snapshot(source).items():
                rows.write.mode("overwrite").parquet(f"{out}/snapshot/{label}/{name}")
            stored.add(label)
        return label

    def now() -> str:
        if isinstance(tables, SnapshotTables):
            latest = tables.latest()
            return store(f"version-{latest.version}", latest)
        return store(started, tables)

    def used(number: int) -> str:
        """The snapshot of a batch: the recorded one, else the latest, which is recorded."""
        record = f"{out}/versions/batch={number}"
        if folder_exists(spark, record):
            known = spark.read.schema("label STRING").json(record).first()
            if known:
                return known["label"]
        label = now()
        spark.range(1).select(F.lit(label).alias("label")).coalesce(1).write.mode("overwrite").json(record)
        return label

    def write(batch: DataFrame, number: int) -> None:
        label = used(number)
        known = {name: spark.read.parquet(f"{out}/snapshot/{label}/{name}") for name in ("items", "bins", "factors")}
        judged = f"{out}/checked/batch={number}"
        checked(known, batch).write.mode("overwrite").parquet(judged)
        to_post(batch.sparkSession.read.parquet(judged)).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return (
        transactions.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/_progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def txn_stream(tables: Tables, records_per_file: int = 1_000_000, files_per_batch: int = 100) -> DataFrame:
    """Feed the transactions through the stream as files and report what became of each."""
    rows = tables["voorraad_transactie"]
    spark = rows.sparkSession
    folder = run_folder(spark, "txn-stream")
    rows.write.option("maxRecordsPerFile", records_per_file).parquet(f"{folder}/in")
    arriving = read_transactions(spark, f"{folder}/in", files_per_batch)
    start_transactions(tables, arriving, f"{folder}/out").awaitTermination()
    posted = spark.read.parquet(f"{folder}/out/postings").withColumn("outcome", F.lit("posted"))
    judged = spark.read.parquet(f"{folder}/out/checked").select(
        "name", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("outcome"), "reason"
    )
    return posted.unionByName(judged, allowMissingColumns=True).select(
        "name", "outcome", "side", "account", "debit", "credit", "text", "reason"
    )
