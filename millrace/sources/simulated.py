"""A simulated acquisition as a data source (S18): a seal that heats only in a dry run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "session long, block long, seconds double, seal_temp_c double, current_a double"


class Session(InputPartition):
    def __init__(self, number: int):
        self.number = number


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.sessions, self.blocks = int(options.get("sessions", 1)), int(options.get("blocks", 40))
        self.dry, self.ambient, self.rate = options.get("condition", "dry_run") == "dry_run", float(options.get("ambient", 20)), float(options.get("heating", 4))

    def partitions(self) -> list[Session]:
        return [Session(i) for i in range(self.sessions)]

    def read(self, partition: Session) -> Iterator[tuple]:
        for b in range(self.blocks):
            t = b * 0.25
            yield partition.number, b, 0.25, self.ambient + (self.rate * t if self.dry else 0.0), 4.5 if self.dry else 10.0


class SimulatedRig(DataSource):
    """Options: sessions, blocks, condition, ambient, heating (degrees a second)."""

    @classmethod
    def name(cls) -> str:
        return "simulated_rig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def simulated(spark: SparkSession, **options):
    spark.dataSource.register(SimulatedRig)
    return spark.read.format("simulated_rig").options(**{k: str(v) for k, v in options.items()}).load()
