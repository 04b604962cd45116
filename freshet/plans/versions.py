"""Versions of stored artifacts: each is a folder of its own that counts only once it is complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from freshet.session import listed


def folder_of(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v{version:06d}"


def _numbers(paths: list[str], up: int) -> list[int]:
    return [int(p.split("/")[-1 - up].removeprefix("v")) for p in paths]


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    return sorted(_numbers(listed(spark, f"{root.rstrip('/')}/v*/published/_SUCCESS"), 2))


def publish(spark: SparkSession, root: str, save: Callable[[str], None]) -> int:
    """Write the next version with ``save``, which takes its folder, and mark it as complete.

    A version whose writer fails is never marked, so no reader takes it; its number is not used again. One writer at
    a time publishes.
    """
    version = max([0, *_numbers(listed(spark, f"{root.rstrip('/')}/v*"), 0)]) + 1
    folder = folder_of(root, version)
    save(folder)
    spark.range(1).write.json(f"{folder}/published")
    return version
