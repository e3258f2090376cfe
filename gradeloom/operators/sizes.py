"""Size-checked small tables and lineage cuts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# A small table may hold this many rows and bytes; anything larger stays distributed.
SMALL_ROWS = 100_000
SMALL_BYTES = 64 * 1024 * 1024


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a local table if it is small, else None.

    At most ``max_rows + 1`` rows ever reach the driver, taken partition by partition,
    so a large table is recognised from its first rows. The result has no lineage:
    later uses do not recompute ``df``.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    table = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], to_arrow_schema(df.schema))
    return None if table.nbytes > SMALL_BYTES else df.sparkSession.createDataFrame(table, df.schema)


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its checked size allows, else ``df`` itself."""
    local = small_table(df, max_rows)
    return df if local is None else F.broadcast(local)


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    # Without the setting the warehouse serves, which executors share as well.
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
