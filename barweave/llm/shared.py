"""Where intermediate tables go: always a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave.llm.batches import pieces_of

BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> str:
    """From now on rows go to Python in batches of BATCH_ROWS at most, as whole texts should; returns the setting before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    return before


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only if the session names none.

    The fallback serves single-machine sessions such as tests; on any other master its lack is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="barweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. The reader also knows the table's
    size, so that Spark broadcasts it in a join only if it is below the session's limit. Rows that go to Python and
    back hold whole texts, so they go in batches of BATCH_ROWS at most. ``free`` deletes the shuffle files of this job
    as soon as it ends, rather than when the driver's garbage is next collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before, kept = small_batches(spark), spark.conf.get(_FREE, "false")
    try:
        spark.conf.set(_FREE, "true" if free else kept)
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
        spark.conf.set(_FREE, kept)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again, so that they take no disk for the rest of a run."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(documents: DataFrame, with_hash: bool = False) -> DataFrame:
    """doc_id and the text's bytes compressed, for shuffles, and xxhash64 of the text if wanted; null texts are empty."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for part in pieces_of(batches, 512):
            names = ["doc_id", "packed", *["text_hash"] * with_hash]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(x or b"") for x in part.column(1).cast("binary").to_pylist()], pa.binary()), *part.columns[2:]], names=names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[F.xxhash64(text).alias("text_hash")] * with_hash]
    return documents.select(*columns).mapInArrow(run, "doc_id long, packed binary" + ", text_hash long" * with_hash)


def packed_among(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """As ``packed``, of the documents that may be among ``ids`` (one column), so that few others travel to a join with it.

    A bitmap of the ids' hashes, of 8 MB at most, tells; it lets others pass, but leaves none of these out.
    """
    size = 1 << max(16, min(26, (16 * ids.count()).bit_length()))
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(size)).cast("int")
    at = ids.select(place(F.col(ids.columns[0]).cast("long")).alias("at"))
    told = at.groupBy(F.expr("at >> 5").alias("word")).agg(F.bit_or(F.expr("shiftleft(1, at & 31)")).alias("bits")).toArrow()
    bits = np.zeros(size >> 5, dtype=np.int32)
    bits[told.column("word").to_numpy()] = told.column("bits").to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in pieces_of(batches, 512):
            at = batch.column(2).to_numpy()
            own = batch.filter(pa.array(shared.value[at >> 5] >> (at & 31) & 1 == 1))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([pack(x or b"") for x in own.column(1).cast("binary").to_pylist()], pa.binary())], names=["doc_id", "packed"])

    doc = F.col("doc_id").cast("long")
    return documents.where(doc.isNotNull()).select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), place(doc).alias("at")).mapInArrow(run, "doc_id long, packed binary")
