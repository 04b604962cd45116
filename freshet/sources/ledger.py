"""What a scan loses: counts taken inside the scan itself, without another pass."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Counts of a ledger, in the order in which they are reported.
COUNTS = ["lines", "damaged_lines", "unreadable_dates", "short_lines", "cells", "unreadable_cells"]


class Ledger:
    """Counts of one wide file, filled by the first action on what is read from it.

    ``lines`` are those with data, after comments and titles; ``damaged_lines`` held bytes that are not UTF-8. Of the
    lines, ``unreadable_dates`` are dropped; ``short_lines`` end before the last column and ``unreadable_cells`` are
    neither numbers nor marks of missing values: both become missing. ``cells`` are those of lines with a date.
    """

    def __init__(self, source: str):
        self.source = source
        self._seen: list[tuple[Observation, DataFrame, list[Column]]] = []

    def _observed(self, df: DataFrame, *counts: Column) -> DataFrame:
        seen = Observation()
        self._seen.append((seen, df, list(counts)))
        return df.observe(seen, *counts)

    def bytes_of(self, text: DataFrame) -> DataFrame:
        return self._observed(text, F.count_if(~F.is_valid_utf8("value")).alias("damaged_lines"))

    def lines_of(self, parsed: DataFrame, time: str) -> DataFrame:
        data = ~F.col("title")
        return self._observed(
            parsed,
            F.count_if(data).alias("lines"),
            F.count_if(data & F.col(time).isNull()).alias("unreadable_dates"),
            F.count_if(data & F.col("short")).alias("short_lines"),
        )

    def cells_of(self, cells: DataFrame, unreadable: Column) -> DataFrame:
        return self._observed(cells, F.count("*").alias("cells"), F.count_if(unreadable).alias("unreadable_cells"))

    def counts(self) -> dict[str, int]:
        """All counts; waits for the first action on the data.

        Where adaptive execution has cut a scan out of its final plan, as it does once the scan turns out empty, the
        observation is lost and the counts are taken by a pass of their own.
        """
        held: dict[str, int] = {}
        for seen, df, counts in self._seen:
            try:
                found = seen.get
            except Py4JJavaError:
                found = {}
            held |= found or df.agg(*counts).first().asDict()
        return {name: int(held.get(name) or 0) for name in COUNTS}

    def check(self) -> dict[str, int]:
        """The counts; an error if the file has data lines and none has a readable date."""
        counts = self.counts()
        if counts["lines"] and counts["lines"] == counts["unreadable_dates"]:
            raise ValueError(f"{self.source}: none of {counts['lines']} lines has a readable date")
        return counts

    def table(self, spark: SparkSession) -> DataFrame:
        counts = self.counts()
        return spark.createDataFrame([(self.source, *counts.values())], "source string, " + ", ".join(f"{c} bigint" for c in COUNTS))
