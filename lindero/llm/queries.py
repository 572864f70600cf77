"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, langid, linededup, media, neardup, packing, pii, quality, sptok, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": packing.op1_pack,
    "op2_warc": warc.op2_warc,
    "op3_media": media.op3_media,
    "op4_skipchain": pii.op4_skipchain,
    "op5_ppm": langid.op5_ppm,
    "op6_neardup": neardup.op6_neardup,
    "op7_brown": brown.op7_brown,
    "op8_lines": linededup.op8_lines,
    "op9_quality": quality.op9_quality,
    "op10_pieces": sptok.op10_pieces,
}

ORACLES: dict[str, str] = {"op9_quality": quality.OP9_SQL}
