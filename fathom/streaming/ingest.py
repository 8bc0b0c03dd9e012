"""Files as they arrive: their chunks, and an index that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fathom.operators import bm25
from fathom.operators.chunkers import chunk_texts
from fathom.runtime import small_batches
from fathom.sources.files import exists


def stream_chunks(spark: SparkSession, folder: str, out: str, checkpoint: str, mode: str = "token", size: int = 256, overlap: int = 50, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Read Parquet files that appear in ``folder``, chunk them and append to ``out``. Chunkers keep
    no state between rows, so the stream needs none either; the checkpoint makes it exactly once."""
    docs: DataFrame = spark.readStream.schema(schema).parquet(folder)
    chunks = chunk_texts(docs, mode, size, overlap)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_index(spark: SparkSession, folder: str, index: str, checkpoint: str, schema: str = "doc_id long, text string", files: int = 1000, doc: str = "doc_id", text: str = "text", lower: bool = False) -> StreamingQuery:
    """Keep a text index up to date with Parquet files that appear in ``folder``, ``files`` a batch.

    A batch adds its segments and their counts of terms, in folders of the batch's number that it
    writes whole, so that a batch that is done again after a failure leaves the same. Nothing that
    earlier batches wrote is read. If rows have a column ``deleted``, those where it is true take away
    the documents of their id that earlier batches brought; a new text may come in the same batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        gone = batch.where("deleted") if "deleted" in batch.columns else batch.limit(0)
        kept = batch.where("not coalesce(deleted, false)") if "deleted" in batch.columns else batch
        segments = bm25.segments_of(kept, doc, text, lower)
        with small_batches(segments.sparkSession):
            segments.write.mode("overwrite").options(**bm25.SEGMENT_FILES).parquet(f"{index}/segments/batch={number}")
        made = spark.read.parquet(f"{index}/segments/batch={number}")
        bm25.counted(made).write.mode("overwrite").parquet(f"{index}/counts/batch={number}")
        gone.select(F.col(doc).alias("doc")).write.mode("overwrite").parquet(f"{index}/gone/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_index(spark: SparkSession, index: str, lower: bool = False) -> bm25.SparseIndex:
    """The index that ``stream_index`` has written so far: counts of its batches added up, documents
    that were taken away left out."""
    if not exists(spark, f"{index}/segments"):
        raise FileNotFoundError(index)
    counts = spark.read.parquet(f"{index}/counts").groupBy("grp", "term").agg(F.sum("df").alias("df"))
    made = bm25.SparseIndex(spark.read.parquet(f"{index}/segments"), counts, lower)
    gone = spark.read.parquet(f"{index}/gone")
    return bm25.remove_documents(made, gone) if gone.limit(1).count() else made
