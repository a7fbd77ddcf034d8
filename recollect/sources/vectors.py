"""Vectors as fixed-width float32 records, little-endian, row by ordinal: a data source that reads ranges of records and a
writer that commits.

A folder holds parts and a list of them, put in place last. The folder is on a file system that the driver and all
executors mount, as records are sought by place."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, LIST = "float_records", "_parts.json"
#: Records of a partition, and of a batch.
PARTITION, BATCH = 65_536, 2_048


@dataclass
class Records(InputPartition):
    path: str
    at: int  # record in the file
    first: int  # its ordinal
    count: int


@dataclass
class Part(WriterCommitMessage):
    name: str
    first: int
    count: int


def _folder(options: dict) -> str:
    return options["path"].removeprefix("file://")


class FloatRecords(DataSource):
    """(ordinal, vector). Options: path, width (floats of a record), partition (records of a partition)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "ordinal long, vector array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_folder(self.options), int(self.options["width"]), int(self.options.get("partition", PARTITION)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_folder(self.options), int(self.options["width"]))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, width: int, size: int):
        self.folder, self.width, self.size = folder, width, size
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        """Bounds of the ordinal choose the records that are read; Spark checks what is left."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ordinal",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[Records]:
        with open(f"{self.folder}/{LIST}", encoding="utf-8") as file:
            parts = json.load(file)
        out = []
        for part in parts:
            low, high = max(self.low, part["first"]), min(self.high, part["first"] + part["count"])
            out += [Records(f"{self.folder}/{part['name']}", at - part["first"], at, min(self.size, high - at)) for at in range(low, high, self.size)]
        return out or [Records("", 0, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        done, row = 0, 4 * self.width
        while done < partition.count:
            n = min(BATCH, partition.count - done)
            with open(partition.path, "rb") as file:
                file.seek((partition.at + done) * row)
                data = file.read(n * row)
            if len(data) != n * row:
                raise ValueError(f"{partition.path} ends within a record")
            values = np.frombuffer(data, "<f4").reshape(n, self.width)
            # a record of nothing but NaN stands for null
            gone = np.isnan(values).all(axis=1)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * self.width)
            lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), pa.float32()), mask=pa.array(gone))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first + done, partition.first + done + n)), lists], ["ordinal", "vector"])
            done += n


class _Writer(DataSourceArrowWriter):
    """Every task writes the records it is given, which must follow each other, as a part; the commit lists the parts if
    they leave no gap."""

    def __init__(self, folder: str, width: int):
        self.folder, self.width = folder, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        name, first, count = f"part-{uuid.uuid4().hex}.f32", None, 0
        with open(f"{self.folder}/{name}", "wb") as file:
            for batch in iterator:
                ordinals = batch.column("ordinal").to_pylist()
                for ordinal, vector in zip(ordinals, batch.column("vector").to_pylist(), strict=True):
                    first = ordinal if first is None else first
                    if ordinal != first + count or (vector is not None and len(vector) != self.width):
                        raise ValueError(f"record {ordinal} is out of turn or not {self.width} wide")
                    file.write(np.array([np.nan] * self.width if vector is None else [np.nan if x is None else x for x in vector], "<f4").tobytes())
                    count += 1
        return Part(name, first or 0, count)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted(({"name": m.name, "first": m.first, "count": m.count} for m in messages if m and m.count), key=lambda p: p["first"])
        if any(p["first"] != sum(q["count"] for q in parts[:k]) for k, p in enumerate(parts)):
            raise ValueError("ordinals leave a gap or repeat")
        with open(f"{self.folder}/{LIST}.new", "w", encoding="utf-8") as file:
            json.dump(parts, file)
        os.replace(f"{self.folder}/{LIST}.new", f"{self.folder}/{LIST}")

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m:
                os.unlink(f"{self.folder}/{m.name}")


def write_vectors(rows: DataFrame, path: str, width: int) -> None:
    """rows(ordinal, vector) as a folder of records; ordinals are 0, 1, 2 and so on, a null vector is a record of NaN.
    A crash before the commit leaves what was there; readers see the old list or the new one."""
    spark = rows.sparkSession
    spark.dataSource.register(FloatRecords)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.selectExpr("cast(ordinal AS bigint) AS ordinal", "cast(vector AS array<float>) AS vector").repartitionByRange(tasks, "ordinal").sortWithinPartitions("ordinal")
    dealt.write.format(FORMAT).option("width", width).mode("append").save(path)


def read_vectors(spark: SparkSession, path: str, width: int, partition: int = PARTITION) -> DataFrame:
    """(ordinal, vector). Bounds on the ordinal choose the records that are read at all; so the session is set to show
    filters to Python sources (spark.sql.python.filterPushdown.enabled)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FloatRecords)
    return spark.read.format(FORMAT).option("width", width).option("partition", partition).load(path)
