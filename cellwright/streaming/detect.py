"""Detectors over streams of records: row-local votes against a fixed profile, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators import detect
from cellwright.operators.cells import cells
from cellwright.spec import TableSpec


def stream_votes(records: DataFrame, spec: TableSpec, profile: DataFrame, counts: DataFrame) -> DataFrame:
    """recid, attr, value and the votes of all column detectors for each record of a stream.

    profile and counts (``column_profile`` and ``value_counts`` of past data) are static; the profile, of one row an
    attribute, is broadcast.
    """
    joined = cells(records, spec).join(counts, ["attr", "value"], "left").join(F.broadcast(profile), "attr", "left")
    return joined.select("recid", "attr", "value", *[c.alias(n) for n, c in detect.column_detectors(spec).items()])
