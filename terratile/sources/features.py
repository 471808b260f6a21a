"""Reading and writing of exchange formats: features, label text, ranked tables.

Features are written one to a line, so that a file can be split; whole
collections are read too, each by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RING = "array<array<array<double>>>"


def feature_lines(rows: DataFrame, ring: Column, properties: list[str]) -> DataFrame:
    """One column ``value``: a polygon feature with the properties as JSON; ``ring`` is an array of [lon, lat]."""
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def read_features(spark: SparkSession, path: str, properties: str, collections: bool = False) -> DataFrame:
    """Features of files of lines, or of files that each hold one collection: ``ring`` and the properties as typed columns."""
    feature = f"type string, geometry struct<type: string, coordinates: {_RING}>, properties struct<{properties}>"
    if collections:
        rows = spark.read.schema(f"features array<struct<{feature.replace('type string', 'type: string', 1).replace(', geometry ', ', geometry: ').replace(', properties ', ', properties: ')}>>")
        rows = rows.option("multiLine", True).json(path).select(F.inline("features"))
    else:
        rows = spark.read.schema(feature).json(path)
    return rows.select(F.col("geometry.coordinates")[0].alias("ring"), "properties.*")


def export_errors(ring: Column, required: dict[str, Column], dates: list[Column], digest: Column) -> Column:
    """What is wrong with a feature, as an array of codes in this order; empty if nothing is.

    ``ring``: closed, four positions at least; ``range``: longitudes and
    latitudes; ``missing:<name>``: a required property; ``dates``: not two real
    days; ``digest``: not 64 hexadecimal digits.  A null part is wrong.
    """
    sound = (F.size(ring) >= 4) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
    ranged = F.forall(ring, lambda p: p[0].between(-180, 180) & p[1].between(-90, 90))
    real = F.lit(True)
    for d in dates:
        real = real & F.coalesce(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))
    tests = [("ring", sound), ("range", ranged), *[(f"missing:{k}", v.isNotNull()) for k, v in required.items()], ("dates", real), ("digest", digest.rlike("^[0-9a-f]{64}$"))]
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(code)) for code, ok in tests]))


def label_lines(boxes: DataFrame, folder: str = "image_id") -> DataFrame:
    """(folder, value): eight coordinates, class and difficulty of each box, separated by blanks."""
    corners = ["x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"]
    return boxes.select(folder, F.concat_ws(" ", *[F.col(c).cast("string") for c in corners], F.col("class_id").cast("string"), F.lit("0")).alias("value"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of label text: corners as an array of eight numbers, class, difficult; lines of fewer than ten fields are headers and left out.

    A partition column of the path (image_id=...) comes along.
    """
    rows = spark.read.text(path).withColumn("f", F.split(F.trim("value"), r"\s+")).where(F.size("f") >= 10)
    return rows.withColumns(
        {"corners": F.transform(F.slice("f", 1, 8), lambda v: v.cast("double")), "class_id": F.col("f")[8], "difficult": F.col("f")[9] != "0"}
    ).drop("value", "f")


def read_label_headers(spark: SparkSession, path: str) -> DataFrame:
    """The ``gsd:`` value of label files, with the partition columns of the path; null where it is no number."""
    rows = spark.read.text(path).where(F.col("value").startswith("gsd:"))
    return rows.withColumn("gsd", F.substring("value", 5, 100).try_cast("double")).drop("value")
