"""Tables and files in the folder that the whole cluster shares, and rows dealt to bins."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maxentnet.plans.scratch import delete, folder, forget, written

__all__ = ["Blobs", "attached", "blob", "by_bin", "delete", "folder", "forget", "is_hot", "parts", "written"]


def parts(spark: SparkSession) -> int:
    """How many partitions the cluster's owner asks of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bin(df: DataFrame, key: str, *then: str) -> DataFrame:
    """Rows dealt by ``key`` and in the order of ``key`` and ``then`` within each partition."""
    return df.repartition(parts(df.sparkSession), key).sortWithinPartitions(key, *then)


def attached(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Rows with what ``table`` (one row a key) has for their key, nulls where it has none. Rows of the keys in ``hot``, of a bounded number, stay where they are and get theirs by broadcast."""
    hot = hot.select(key)
    often = rows.join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))


#: A key with more rows than this is hot, and with more than a MOST_HOT-th of all: so there are at most MOST_HOT hot keys.
HOT, MOST_HOT = 1024, 100_000


def is_hot(count: Column, rows: int) -> Column:
    """Of a key's number of rows among so many."""
    return count > F.lit(max(HOT, rows // MOST_HOT))


class Blobs:
    """Byte strings put one after another into one file of a folder (any that pyarrow opens); the file's name is never used twice, so a repeated task leaves the first one's alone."""

    def __init__(self, base: str):
        self.store, self.path = fs.FileSystem.from_uri(base)
        self.name, self.at, self.out = uuid.uuid4().hex, 0, None

    def put(self, data: bytes) -> tuple[str, int, int]:
        """The place: name, offset and length."""
        if self.out is None:
            self.store.create_dir(self.path, recursive=True)
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}")
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def blob(base: str, place: tuple[str, int, int]) -> bytes:
    store, path = fs.FileSystem.from_uri(base)
    name, offset, length = place
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read_at(length, offset)
