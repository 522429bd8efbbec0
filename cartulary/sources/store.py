"""Tables written once and read back: raw extracts and captured snapshots.

A captured snapshot is a folder with one Parquet table per entry, partitioned
by ``snapshot_id``. Readers filter one ``snapshot_id`` and so touch only its
files; the reader's schema is the writer's, nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, functions as F

Tables = Mapping[str, DataFrame]


class LazyTables(Mapping):
    """Tables by name, each made when it is first asked for: a query pays for those it reads."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}
        self._locks = {name: Lock() for name in makers}

    def __getitem__(self, name: str) -> DataFrame:
        maker = self._makers[name]
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = maker()
            return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def together(self, *names: str) -> None:
        """Make tables that do not need each other side by side."""
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(self.__getitem__, names))


def each(tables: Tables, change: Callable[[DataFrame], DataFrame]) -> Tables:
    """Every table changed in the same way, once it is asked for."""
    return LazyTables({name: lambda name=name: change(tables[name]) for name in tables})


def land(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and return the stored table; partitioned by snapshot where it has one."""
    # Hashes are most of what is stored: hex digits need a codec that codes by entropy.
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if "snapshot_id" in df.columns:
        # Only the snapshots written are replaced; others in the folder stay.
        writer = writer.partitionBy("snapshot_id").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return stored.select(*df.columns)


def at(tables: Tables, snapshot_id: str) -> Tables:
    """One consistent point in time: every table filtered on the same snapshot."""
    return each(tables, lambda frame: frame.filter(F.col("snapshot_id") == snapshot_id) if "snapshot_id" in frame.columns else frame)
