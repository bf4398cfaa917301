"""Reading and writing stream records: recorded then live, routed sinks, datagram files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv")
#: Output layouts by transport; separate streams over plain UDP have none.
LAYOUTS = {("separate", "rtp"), ("transport", "udp"), ("transport", "rtp")}


def read_units(spark: SparkSession, path: str, fmt: str, schema: StructType | str) -> DataFrame:
    """Records with a schema that is fixed beforehand; malformed ones fail the read."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.schema(schema)
    return (reader.option("mode", "FAILFAST") if fmt in ("json", "csv") else reader).format(fmt).load(path)


def stream_units(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 8) -> DataFrame:
    """The same as a stream of Parquet files; files_per_trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def recorded_then_live(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """Recorded records first, then live ones, numbered on through both in each stream: adds ordinal and origin."""
    both = recorded.withColumn("origin", F.lit("recorded")).unionByName(live.withColumn("origin", F.lit("live")))
    w = Window.partitionBy("stream_id").orderBy(F.col("origin") == "live", "sequence")
    return both.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def write_ordered(units: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Interleaved by time inside every file, streams kept together."""
    units.repartition("stream_id").sortWithinPartitions("pts", "stream_id", "sequence").write.format(fmt).mode("errorifexists").save(path)


def write_routed(units: DataFrame, path: str, column: str = "stream_kind") -> None:
    """A folder for each branch, in one pass over the input."""
    units.write.partitionBy(column).parquet(path)


def check_layout(layout: str, transport: str) -> None:
    if (layout, transport) not in LAYOUTS:
        raise ValueError(f"no {layout} output over {transport}")
