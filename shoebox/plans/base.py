"""Registration of queries beside their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None):
        def register(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
