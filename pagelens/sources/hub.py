"""A dataset in shards with splits, as a data source: a partition a shard, columns and shards chosen before any is opened.

The folder holds Parquet shards below the name of their split, and a manifest: for each shard its split, file,
rows, and the least and greatest value of the columns that shards are told apart by.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

MANIFEST = "manifest.jsonl"


def _at(path: str):
    """File system and path of an address that executors share (file, hdfs, s3 ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Shard(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class HubReader(DataSourceReader):
    def __init__(self, path: str, split: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns
        files, base = _at(f"{self.path}/{MANIFEST}")
        with files.open_input_stream(base) as f:
            shards = [json.loads(line) for line in f.read().decode().splitlines()]
        self.shards = [s for s in shards if s["split"] == split]
        if not self.shards:
            raise ValueError(f"no split {split}; there are {', '.join(sorted({s['split'] for s in shards}))}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Shards in which no row can fit go; Spark still applies every filter to the rows."""
        for f in filters:
            self.shards = [s for s in self.shards if self._may(f, s)]
            yield f

    @staticmethod
    def _may(f: Filter, shard: dict) -> bool:
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
            return True
        low, high = shard["low"].get(f.attribute[0]), shard["high"].get(f.attribute[0])
        values = list(f.value) if isinstance(f, In) else [f.value]
        if len(f.attribute) > 1 or low is None or high is None or any(type(v) is not type(low) for v in values):
            return True
        if isinstance(f, (EqualTo, In)):
            return any(low <= v <= high for v in values)
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return high > f.value or (high == f.value and isinstance(f, GreaterThanOrEqual))
        return low < f.value or (low == f.value and isinstance(f, LessThanOrEqual))

    def partitions(self) -> list[InputPartition]:
        return [Shard(s["file"]) for s in self.shards] or [Shard("")]

    def read(self, partition: Shard) -> Iterator:
        import pyarrow.parquet as pq

        if not partition.file:
            return
        files, at = _at(f"{self.path}/{partition.file}")
        with files.open_input_file(at) as f:
            yield from pq.ParquetFile(f).iter_batches(columns=self.columns)


class Hub(DataSource):
    """Options: path, split, columns (comma-separated; all if left out) and schema (of all columns, as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "hub"

    def schema(self) -> StructType:
        full = StructType.fromJson(json.loads(self.options["schema"]))
        return StructType([full[c] for c in self._columns(full)])

    def _columns(self, full: StructType) -> list[str]:
        chosen = self.options.get("columns")
        return [c.strip() for c in chosen.split(",")] if chosen else full.fieldNames()

    def reader(self, schema: StructType) -> HubReader:
        return HubReader(self.options["path"], self.options.get("split", "train"), schema.fieldNames())


def read_hub(spark: SparkSession, path: str, schema: str, split: str = "train", columns: list[str] | None = None) -> DataFrame:
    """A split of a sharded dataset. Only its shards are opened, of those only the ones whose least and greatest values
    let a filter on the result hold, and only the columns named are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Hub)
    x = spark.read.format("hub").option("path", path).option("split", split).option("schema", StructType.fromDDL(schema).json())
    return (x.option("columns", ",".join(columns)) if columns else x).load()


def write_hub(splits: dict[str, DataFrame], path: str, by: str, shards: int) -> None:
    """Splits as shards in ranges of column by, with the manifest, a row a shard, written last."""
    spark = next(iter(splits.values())).sparkSession
    rows = None
    for split, df in splits.items():
        df.repartitionByRange(shards, by).write.parquet(f"{path}/{split}")
        file = F.concat(F.lit(f"{split}/"), F.substring_index(F.input_file_name(), "/", -1))
        x = spark.read.schema(df.schema).parquet(f"{path}/{split}").groupBy(F.lit(split).alias("split"), file.alias("file"))
        x = x.agg(F.count(F.lit(1)).alias("rows"), F.struct(F.min(by).alias(by)).alias("low"), F.struct(F.max(by).alias(by)).alias("high"))
        rows = x if rows is None else rows.unionByName(x)
    lines = [r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()]  # a line a shard
    files, at = _at(f"{path}/{MANIFEST}")
    with files.open_output_stream(at) as f:
        f.write("\n".join(sorted(lines)).encode())
