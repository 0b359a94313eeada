"""SPU register: registered products only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spendscope.sources.tables import drop_missing


def registered_spus(register: DataFrame) -> DataFrame:
    return drop_missing(register, "SPU")
