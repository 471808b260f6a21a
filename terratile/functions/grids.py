"""Universal transverse Mercator columns of a place, by the usual series in the third flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the ellipsoid and projection.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * _K0
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_E = 2 * _N**0.5 / (1 + _N)
#: Latitude bands from 80 degrees south, columns and rows of the 100 km squares.
BANDS, COLUMNS, ROWS = "CDEFGHJKLMNPQRSTUVWXX", ["ABCDEFGH", "JKLMNPQR", "STUVWXYZ"], "ABCDEFGHJKLMNPQRSTUV"

#: Expressions over phi, dl (radians), then t, then xi and eta.
T = f"sinh(atanh(sin(phi)) - {_E!r} * atanh({_E!r} * sin(phi)))"
TERMS = "atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta"
EASTING = f"500000 + {_R!r} * (eta + " + " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1)) + ")"
NORTHING = f"CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {_R!r} * (xi + " + " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1)) + ")"


def with_grid(rows: DataFrame) -> DataFrame:
    """Adds zone, band, easting, northing (m) and square, the name of the 100 km square, to rows with lon and lat (80 south to 84 north)."""
    zone = F.floor((F.col("lon") + 180) / 6) % 60 + 1
    out = rows.withColumns({"zone": zone, "band": F.substring(F.lit(BANDS), F.floor((F.col("lat") + 80) / 8).cast("int") + 1, F.lit(1))})
    out = out.withColumns({"phi": F.radians("lat"), "dl": F.radians(F.col("lon") - (F.col("zone") * 6 - 183))}).withColumn("t", F.expr(T))
    out = out.selectExpr("*", TERMS.split(" AS xi, ")[0] + " AS xi", TERMS.split(" AS xi, ")[1]).withColumns({"easting": F.expr(EASTING), "northing": F.expr(NORTHING)})
    set_ = F.element_at(F.array(*map(F.lit, COLUMNS)), ((F.col("zone") - 1) % 3 + 1).cast("int"))
    column = F.substring(set_, F.floor(F.col("easting") / 100000).cast("int"), F.lit(1))
    row = F.floor(F.col("northing") / 100000) + F.when(F.col("zone") % 2 == 0, 5).otherwise(0)
    square = F.concat(F.col("zone").cast("string"), "band", column, F.substring(F.lit(ROWS), (row % 20 + 1).cast("int"), F.lit(1)))
    return out.withColumn("square", square).drop("phi", "dl", "t", "xi", "eta")
