"""Pluggable listing sources: any function from a landed table to flat records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeledger.operators.grouped import top_per_group

Extractor = Callable[[DataFrame], DataFrame]


class Sources:
    """Named extractors; new sources are added with :meth:`register`."""

    def __init__(self) -> None:
        self._extractors: dict[str, Extractor] = {}

    def register(self, name: str, extractor: Extractor) -> None:
        self._extractors[name] = extractor

    def names(self) -> list[str]:
        return list(self._extractors)

    def extract(self, landed: dict[str, DataFrame]) -> DataFrame:
        """Records of all given landed tables, columns united by name."""
        unknown = set(landed) - set(self._extractors)
        if unknown:
            raise ValueError(f"no extractor for: {sorted(unknown)}")
        frames = [
            self._extractors[n](df).withColumn("data_source", F.lit(n)) for n, df in landed.items()
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def cap_per_search(
    records: DataFrame, cap: int, job: str = "job_id", order: tuple = ("page", "pos")
) -> DataFrame:
    """The first ``cap`` records of each search, in page order (the search's own limit)."""
    return top_per_group(records, [job], [F.col(c) for c in order], cap)
