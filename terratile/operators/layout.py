"""A layout of boxes on disk in which a filter by a box skips most of the table.

Rows are put in order of the Hilbert curve of their centres and written in small
row groups; Parquet keeps the least and largest west, south, east and north of
each, and Spark's pushed filters leave out files and row groups that cannot
meet the box.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terratile.functions.curves import hilbert_keys
from terratile.storage import shared_dir

BITS = 16
GROUP_BYTES, FILE_ROWS = 1 << 20, 1 << 20


@F.pandas_udf(T.LongType())
def _place(lon: pd.Series, lat: pd.Series) -> pd.Series:
    cells = pd.DataFrame({"x": (lon + 180) / 360, "y": (lat + 90) / 180}).fillna(0).clip(0, 1 - 2**-BITS) * (1 << BITS)
    return pd.Series(hilbert_keys(cells.to_numpy().astype("int64"), BITS))


def write_layout(boxes: DataFrame, name: str = "layout", group_bytes: int = GROUP_BYTES, file_rows: int = FILE_ROWS) -> DataFrame:
    """``boxes`` (west, south, east, north and any columns) written along the curve, and read back.  Rows without a box come first."""
    keyed = boxes.withColumn("_key", _place((F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2))
    files = max(1, -(-boxes.count() // file_rows))
    path = shared_dir(boxes.sparkSession, name)
    dealt = keyed.repartitionByRange(files, "_key").sortWithinPartitions("_key").drop("_key")
    dealt.write.option("parquet.block.size", group_bytes).option("parquet.page.size", min(group_bytes, 1 << 16)).parquet(path)
    return boxes.sparkSession.read.schema(boxes.schema).parquet(path)
