"""Functions that give tables, for use in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="suffix string, tokens int")
class Suffixes:
    """suffixes(name): every `_` suffix of a name, longest first, and its count of tokens; none of a null."""

    def eval(self, name: str) -> Iterator[tuple[str, int]]:
        if name is not None:
            tokens = name.split("_")
            for k in range(len(tokens)):
                yield "_".join(tokens[k:]), len(tokens) - k


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("suffixes", Suffixes)
