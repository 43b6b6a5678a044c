"""Rows that fail to parse: strict load plus anti-join.

Offsets (the record's identity) are kept through the load; only conforming rows are loaded; the loaded offsets are
subtracted from the raw ones, and what remains is diagnosed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.runtime import spread, stored
from tripleloom.sources.ntriples import NO_STATEMENT, parsed, reason, value_fits


@dataclass
class Loaded:
    valid: DataFrame
    _remainder: Callable[[], DataFrame]

    @cached_property
    def failed(self) -> DataFrame:
        """Found when first asked for, once."""
        return self._remainder()


def strict_load(lines: DataFrame, offset: str = "line_id", text: str = "stmt") -> Loaded:
    """Splits raw statements into triples and failures.

    valid: the offset, s_kind, s_lex, p_lex, o_kind, o_lex, o_lang, o_dt of each conforming line (repeats are kept).
    failed: the offset, the text and the reason of every other line that is a statement.
    Null, blank and comment lines are no statements and in neither. Rows are told apart by offset and text together, so
    a null or repeated offset neither hides nor invents a failure; equal failing rows come as often as they are there.
    Other columns of the input are ignored, whatever their names. An empty input gives two empty results."""
    raw = spread(lines.select(F.col(f"`{offset}`").alias("_offset"), F.col(f"`{text}`").alias("_text"))).where(~F.col("_text").rlike(NO_STATEMENT))
    rows = parsed(raw, "_text", ["_offset", "_text"]).where(F.col("well_formed") & value_fits(F.col("o_lex"), F.col("o_dt")))
    valid = rows.select(F.col("_offset").alias(offset), "s_kind", "s_lex", "p_lex", "o_kind", "o_lex", "o_lang", "o_dt")

    def remainder() -> DataFrame:
        # Offsets and hashes of the texts are all that is subtracted; the few texts left are fetched by a semi-join, for which Spark
        # broadcasts what is left where its size allows.
        keys = raw.select(F.col("_offset").alias("_key"), F.xxhash64("_text").alias("_mine"))
        done = rows.select(F.col("_offset").alias("_done"), F.xxhash64("_text").alias("_hash"))
        # What is left is written first, so that its size is known when the texts are fetched.
        left = stored(keys.join(done, F.col("_key").eqNullSafe(F.col("_done")) & (F.col("_mine") == F.col("_hash")), "left_anti"), "left")
        rest = raw.join(left, F.col("_offset").eqNullSafe(F.col("_key")) & (F.xxhash64("_text") == F.col("_mine")), "left_semi")
        again = parsed(rest, "_text", ["_offset", "_text"])
        return again.select(F.col("_offset").alias(offset), F.col("_text").alias(text), reason(F.col("_text"), F.col("o_lex"), F.col("o_dt"), F.col("well_formed")).alias("reason"))

    return Loaded(valid, remainder)
