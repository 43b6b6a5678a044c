"""Continuous loading: new N-Triples files of a folder become triples, failed lines go beside them with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleloom.sources.ntriples import NO_STATEMENT, parsed, reason, value_fits


def stream_lines(spark: SparkSession, path: str, files_at_once: int = 1_000) -> DataFrame:
    """file_name, stmt of the lines of files that appear under ``path``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).format("text").load(path)
    return lines.select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("stmt"))


def split(lines: DataFrame) -> DataFrame:
    """file_name, stmt, the parsed columns, and reason: null for triples."""
    rows = parsed(lines.where(~F.col("stmt").rlike(NO_STATEMENT)), "stmt", ["file_name", "stmt"])
    good = F.col("well_formed") & value_fits(F.col("o_lex"), F.col("o_dt"))
    return rows.withColumn("reason", F.when(~good, reason(F.col("stmt"), F.col("o_lex"), F.col("o_dt"), F.col("well_formed"))))


def ingest(lines: DataFrame, triples_path: str, failed_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends triples and failures as Parquet, each file's lines exactly once: a batch is written under its own number, so
    that a batch that is run again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        rows = split(batch).persist()
        try:
            rows.where("reason IS NULL").select("file_name", "s_kind", "s_lex", "p_lex", "o_kind", "o_lex", "o_lang", "o_dt").write.mode("overwrite").parquet(f"{triples_path}/batch={number}")
            rows.where("reason IS NOT NULL").select("file_name", "stmt", "reason").write.mode("overwrite").parquet(f"{failed_path}/batch={number}")
        finally:
            rows.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
