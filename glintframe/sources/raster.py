"""Stored bytes as images: rows of blue-green-red samples, as near to a square as the bytes allow.

All of it is columns; nothing is decoded and no byte is left out: the last row is filled with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels that an image has in each direction at least.
LEAST = 8


def raster(df: DataFrame, content: Column) -> DataFrame:
    """``df`` with ``content`` (binary; null counts as empty) as pixels, height, width, channels."""
    data = F.coalesce(content, F.lit(b""))
    size = F.octet_length(data)
    width = F.greatest(F.lit(LEAST), F.ceil(F.sqrt(size / F.lit(3.0)))).cast("int")
    height = F.greatest(F.lit(LEAST), F.ceil(size / (F.col("width") * F.lit(3.0)))).cast("int")
    shaped = df.withColumn("width", width).withColumn("height", height)
    whole = F.rpad(data, F.col("width") * F.col("height") * 3, F.lit(b"\0"))
    return shaped.withColumns({"pixels": whole, "channels": F.lit(3)})
