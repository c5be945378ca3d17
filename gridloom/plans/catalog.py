"""Named queries over the input tables and their SQL equivalents.

The tables hold no raster files, so rasters are defined over them: ``orders``
is a 128-wide raster of whole prices (below 20000 nodata; sums of them are exact in any order) with a palette band of
statuses, ``embeddings`` a 64-wide raster with a row for each vector, and
``part`` a catalogue of raster headers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import grid, profiles
from gridloom.operators import info, pixels, resample, tiles, validate, warp
from gridloom.plans import policy

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return _read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 128").alias("row"), (key % 128).alias("col"), F.when(price >= 20000, F.floor(price).cast("double")).alias("value"))


def status_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 128").alias("row"), (F.col("o_orderkey") % 128).alias("col"), F.col("o_orderstatus").alias("value"))


def vector_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return rows.select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))


ORD = "SELECT o_orderkey // 128 AS row, o_orderkey % 128 AS col, CASE WHEN o_totalprice >= 20000 THEN floor(o_totalprice) END AS value FROM orders"
STATUS = "SELECT o_orderkey // 128 AS row, o_orderkey % 128 AS col, o_orderstatus AS value FROM orders"
VEC = "SELECT vec_id AS row, CAST(i - 1 AS BIGINT) AS col, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)"


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumn("value", F.round("value", digits))


def _overview_sql(source: str, factor: int, value: str, digits: int = 4) -> str:
    return f"SELECT row // {factor} AS row, col // {factor} AS col, count(value) AS n_valid, round({value}, {digits}) AS value FROM ({source}) GROUP BY 1, 2"


_MEAN = "sum(value) / nullif(count(value), 0)"


@query(_overview_sql(ORD, 2, _MEAN))
def overview_average(spark, sf_dir):
    return _rounded(pixels.overview(order_pixels(spark, sf_dir), 2, "average"))


@query(_overview_sql(ORD, 8, _MEAN))
def overview_average_8(spark, sf_dir):
    return _rounded(pixels.overview(order_pixels(spark, sf_dir), 8, "average"))


_TWO = f"SELECT CAST(1 AS INTEGER) AS band, row, col, value FROM ({ORD}) UNION ALL SELECT 2, o_orderkey // 128, o_orderkey % 128, CASE WHEN o_custkey % 4 <> 1 THEN CAST(o_custkey AS DOUBLE) END FROM orders"


@query(f"SELECT band, row // 2 AS row, col // 2 AS col, round({_MEAN}, 4) AS value FROM ({_TWO}) GROUP BY 1, 2, 3 HAVING count(value) > 0")
def overview_band_nodata(spark, sf_dir):
    """Two bands in blocks, each with its own nodata pixels."""
    keys = F.expr("o_orderkey div 128").alias("row"), (F.col("o_orderkey") % 128).alias("col")
    second = F.when(F.col("o_custkey") % 4 != 1, F.col("o_custkey").cast("double"))
    both = order_pixels(spark, sf_dir).withColumn("band", F.lit(1)).unionByName(_read(spark, sf_dir, "orders").select(*keys, second.alias("value"), F.lit(2).alias("band")))
    blocks = tiles.from_pixels(both, 0, 64, 2, "float64", -9999.0)
    small = tiles.overview(blocks, 1, 2, 64, 2, "float64", "average", -9999.0, -9999.0)
    return _rounded(tiles.to_pixels(small, 64, 2, "float64", 64, 1 << 40, -9999.0).where("value is not null"))


@query(_overview_sql(VEC, 4, _MEAN, 6))
def overview_average_vectors(spark, sf_dir):
    return _rounded(pixels.overview(vector_pixels(spark, sf_dir), 4, "average"), 6)


@query(_overview_sql(ORD, 2, "sqrt(sum(value * value) / nullif(count(value), 0))"))
def overview_rms(spark, sf_dir):
    return _rounded(pixels.overview(order_pixels(spark, sf_dir), 2, "rms"))


@query(_overview_sql(ORD, 4, "sum(value)", 2))
def overview_sum(spark, sf_dir):
    return _rounded(pixels.overview(order_pixels(spark, sf_dir), 4, "sum"), 2)


@query(f"SELECT row // 2 AS row, col // 2 AS col, CAST(value IS NOT NULL AS BIGINT) AS n_valid, value FROM ({ORD}) WHERE row % 2 = 0 AND col % 2 = 0")
def overview_nearest(spark, sf_dir):
    return pixels.overview(order_pixels(spark, sf_dir), 2, "nearest")


@query(
    f"""WITH c AS (SELECT row // 2 AS row, col // 2 AS col, value, count(*) AS n FROM ({STATUS}) GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY row, col) AS n_valid, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) AS k FROM c)
SELECT row, col, CAST(n_valid AS BIGINT) AS n_valid, value FROM r WHERE k = 1"""
)
def overview_mode(spark, sf_dir):
    return pixels.overview(status_pixels(spark, sf_dir), 2, "mode")


#: The published kernels as SQL of a distance x.
_KERNEL_SQL = {
    "bilinear": "greatest(0.0, 1 - x)",
    "cubic": "CASE WHEN x < 1 THEN 1.5 * x * x * x - 2.5 * x * x + 1 WHEN x < 2 THEN -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2 ELSE 0.0 END",
    "cubic_spline": "CASE WHEN x < 1 THEN (4 - 6 * x * x + 3 * x * x * x) / 6 WHEN x < 2 THEN (2 - x) * (2 - x) * (2 - x) / 6 ELSE 0.0 END",
    "lanczos": "CASE WHEN x = 0 THEN 1.0 WHEN x < 3 THEN 3 * sin(pi() * x) * sin(pi() * x / 3) / (pi() * x * pi() * x) ELSE 0.0 END",
    "gauss": "CASE WHEN x < 1.5 THEN exp(-2 * x * x) ELSE 0.0 END",
}


def _kernel_sql(method: str, factor: int) -> str:
    return f"""WITH d AS (SELECT place, away, abs((place + 0.5) / {factor} - 0.5 - away) AS x FROM range(0, {factor}) a(place), range(-3, 4) b(away)),
k AS (SELECT place, away, CAST(({_KERNEL_SQL[method]}) / {factor} AS DOUBLE) AS w FROM d), p AS ({VEC}),
own AS (SELECT row // {factor} AS row, col // {factor} AS col, count(value) AS n_valid FROM p GROUP BY 1, 2),
made AS (SELECT row // {factor} + y.away AS row, col // {factor} + x.away AS col, sum(y.w * x.w * value) AS s, sum(y.w * x.w) AS m
  FROM p JOIN k y ON row % {factor} = y.place JOIN k x ON col % {factor} = x.place WHERE value IS NOT NULL AND y.w <> 0 AND x.w <> 0 GROUP BY 1, 2)
SELECT own.row, own.col, n_valid, round(CASE WHEN abs(m) > 1e-9 AND n_valid > 0 THEN s / m END, 6) AS value FROM own LEFT JOIN made ON own.row = made.row AND own.col = made.col"""


def _kernel_query(method: str):
    def run(spark, sf_dir):
        return _rounded(pixels.overview(vector_pixels(spark, sf_dir), 2, method), 6)

    query(_kernel_sql(method, 2), f"overview_{method}")(run)


for _m in pixels.KERNELS:
    _kernel_query(_m)


@query(" UNION ALL ".join(f"SELECT CAST({j} AS BIGINT) AS level, * FROM ({_overview_sql(ORD, 2**j, _MEAN)})" for j in (1, 2, 3)))
def pyramid(spark, sf_dir):
    return _rounded(pixels.pyramid(order_pixels(spark, sf_dir), 3)).select("level", "row", "col", "n_valid", "value")


@query(" UNION ALL ".join(f"SELECT CAST({j} AS BIGINT) AS level, * FROM ({_overview_sql(ORD, 3**j, _MEAN)})" for j in (1, 2)))
def decimation_base3(spark, sf_dir):
    return _rounded(pixels.pyramid(order_pixels(spark, sf_dir), 2, base=3)).select("level", "row", "col", "n_valid", "value")


@query(f"SELECT row, col, CAST(CASE WHEN value IS NULL THEN 0 ELSE 255 END AS BIGINT) AS mask FROM ({ORD})")
def nodata_mask(spark, sf_dir):
    return order_pixels(spark, sf_dir).select("row", "col", pixels.mask(F.col("value")).alias("mask"))


@query("SELECT o_orderkey // 128 AS row, o_orderkey % 128 AS col, CASE WHEN o_custkey % 10 <> 3 THEN o_custkey % 10 END AS value FROM orders")
def nodata_value(spark, sf_dir):
    raw = _read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 128").alias("row"), (F.col("o_orderkey") % 128).alias("col"), (F.col("o_custkey") % 10).alias("value"))
    return pixels.with_nodata(raw, 3)


def _banded(spark, sf_dir) -> DataFrame:
    keys = F.expr("o_orderkey div 128").alias("row"), (F.col("o_orderkey") % 128).alias("col")
    values = F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 7).cast("double"))
    return _read(spark, sf_dir, "orders").select(*keys, F.posexplode(values).alias("p", "value")).select((F.col("p") + 1).alias("band"), "row", "col", "value")


_BANDS = "SELECT b AS band, o_orderkey // 128 AS row, o_orderkey % 128 AS col, CASE b WHEN 1 THEN o_totalprice WHEN 2 THEN CAST(o_custkey AS DOUBLE) ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS value FROM orders, (VALUES (1), (2), (3)) v(b)"


@query(f"SELECT o.out_band AS band, row, col, value FROM ({_BANDS}) p JOIN (VALUES (1, 3), (2, 1), (3, 3)) o(out_band, b) ON p.band = o.b")
def band_select(spark, sf_dir):
    return pixels.select_bands(_banded(spark, sf_dir), (3, 1, 3)).select("band", "row", "col", "value")


@query(f"SELECT CAST(1 AS INTEGER) AS band, row, col, value FROM ({ORD}) UNION ALL SELECT 2, row, col, CASE WHEN value IS NULL THEN 0.0 ELSE 255.0 END FROM ({ORD})")
def alpha_band(spark, sf_dir):
    one = order_pixels(spark, sf_dir).select(F.lit(1).alias("band"), "row", "col", "value")
    return pixels.add_alpha(one, 2)


@query(
    """SELECT o_orderkey AS px, CAST(least(greatest(floor(v + 0.5), 0.0), 255.0) AS BIGINT) AS as_uint8, CAST(least(greatest(floor(v + 0.5), -32768.0), 32767.0) AS BIGINT) AS as_int16,
CAST(CAST(v AS FLOAT) AS DOUBLE) AS as_float32 FROM (SELECT o_orderkey, o_totalprice / 500 AS v FROM orders)"""
)
def dtype_cast(spark, sf_dir):
    v = F.col("o_totalprice") / 500
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("px"), pixels.cast_pixels(v, "uint8").alias("as_uint8"), pixels.cast_pixels(v, "int16").alias("as_int16"), pixels.cast_pixels(v, "float32").alias("as_float32"))


# Catalogue of headers made of the part table ---------------------------------

CATALOG = """SELECT p_partkey AS path, p_partkey * 37 % 4000 + 1 AS width, p_partkey * 53 % 5000 + 1 AS height, CASE WHEN p_size % 3 = 0 THEN 256 ELSE 512 END AS block,
p_retailprice / 100 AS res, p_size FROM part"""


def catalog(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(k.alias("path"), (k * 37 % 4000 + 1).alias("width"), (k * 53 % 5000 + 1).alias("height"), F.when(F.col("p_size") % 3 == 0, 256).otherwise(512).alias("block"), (F.col("p_retailprice") / 100).alias("res"), "p_size")


_LEVELS = "CAST((SELECT min(n) FROM range(0, 41) t(n) WHERE floor(least(width, height) / power(2.0, n)) <= block) AS BIGINT)"


@query(f"SELECT path, width, height, {_LEVELS} AS n_levels FROM ({CATALOG})")
def overview_levels(spark, sf_dir):
    return catalog(spark, sf_dir).select("path", "width", "height", grid.overview_count(F.col("width"), F.col("height"), F.col("block")).alias("n_levels"))


@query(
    f"""SELECT path, CAST(l AS BIGINT) AS level, CAST(CASE WHEN l = 0 THEN 0 ELSE power(2, l) END AS BIGINT) AS decimation, CAST(ceil(width / power(2.0, l)) AS BIGINT) AS width, CAST(ceil(height / power(2.0, l)) AS BIGINT) AS height
FROM (SELECT *, {_LEVELS} AS n FROM ({CATALOG})), LATERAL (SELECT unnest(range(0, n + 1)) AS l)"""
)
def ifd_table(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), grid.overview_count(F.col("width"), F.col("height"), F.col("block")))))
    factor = F.pow(F.lit(2.0), F.col("level"))
    return rows.select("path", "level", F.when(F.col("level") == 0, 0).otherwise(factor).cast("long").alias("decimation"), F.ceil(F.col("width") / factor).cast("long").alias("width"), F.ceil(F.col("height") / factor).cast("long").alias("height"))


@query(
    f"""SELECT path, r AS block_row, c AS block_col, least(512, height - r * 512) AS n_rows, least(512, width - c * 512) AS n_cols FROM ({CATALOG}),
LATERAL (SELECT unnest(range(0, CAST(ceil(height / 512.0) AS BIGINT))) AS r), LATERAL (SELECT unnest(range(0, CAST(ceil(width / 512.0) AS BIGINT))) AS c)"""
)
def block_windows(spark, sf_dir):
    return catalog(spark, sf_dir).select("path", F.inline(pixels.block_windows(F.col("width"), F.col("height"), 512)))


_CELLS = "cells AS (SELECT CAST(z AS BIGINT) AS z, 156543.03392804097 / power(2.0, z) AS c FROM range(0, 31) t(z))"
_FAR = f"SELECT path, res * power(2.0, p_size % 18 - 6) AS res, width, height FROM ({CATALOG})"


def _zoom_sql(strategy: str) -> str:
    step = {"lower": "true", "upper": "false", "auto": "above / res < res / here"}[strategy]
    return f"""WITH {_CELLS}, r AS ({_FAR}), f AS (SELECT r.*, coalesce((SELECT min(z) FROM cells WHERE res > c OR abs(res - c) / c <= 1e-8), 30) AS z FROM r),
g AS (SELECT f.*, h.c AS here, a.c AS above FROM f JOIN cells h ON h.z = f.z LEFT JOIN cells a ON a.z = f.z - 1)
SELECT path, CASE WHEN z > 0 AND abs(res - here) / here > 1e-8 AND ({step}) THEN z - 1 ELSE z END AS zoom FROM g"""


def _far(spark, sf_dir) -> DataFrame:
    return catalog(spark, sf_dir).withColumn("res", F.col("res") * F.pow(F.lit(2.0), F.col("p_size") % 18 - 6))


def _zoom_query(strategy: str):
    def run(spark, sf_dir):
        return _far(spark, sf_dir).select("path", grid.zoom_for_res(F.col("res"), strategy).alias("zoom"))

    query(_zoom_sql(strategy), f"zoom_for_res_{strategy}")(run)


for _s in ("auto", "lower", "upper"):
    _zoom_query(_s)


@query(
    f"""WITH {_CELLS}, r AS ({_FAR}), two AS (SELECT path, 'max' AS k, res FROM r UNION ALL
SELECT path, 'min', res * power(2.0, (SELECT min(n) FROM range(0, 41) t(n) WHERE floor(least(width, height) / power(2.0, n)) <= 256)) FROM r),
f AS (SELECT two.*, coalesce((SELECT min(z) FROM cells WHERE res > c OR abs(res - c) / c <= 1e-8), 30) AS z FROM two),
g AS (SELECT f.*, h.c AS here, a.c AS above FROM f JOIN cells h ON h.z = f.z LEFT JOIN cells a ON a.z = f.z - 1),
d AS (SELECT path, k, CASE WHEN z > 0 AND abs(res - here) / here > 1e-8 AND above / res < res / here THEN z - 1 ELSE z END AS zoom FROM g)
SELECT path, max(zoom) FILTER (WHERE k = 'min') AS min_zoom, max(zoom) FILTER (WHERE k = 'max') AS max_zoom FROM d GROUP BY path"""
)
def min_max_zoom(spark, sf_dir):
    halvings = grid.overview_count(F.col("width"), F.col("height"), 256)
    return _far(spark, sf_dir).select("path", grid.zoom_for_res(F.col("res") * F.pow(F.lit(2.0), halvings)).alias("min_zoom"), grid.zoom_for_res(F.col("res")).alias("max_zoom"))


_BOX = f"SELECT path, -12000000.0 + path % 1000 * 21000.0 AS w, 9000000.0 - path % 777 * 19000.0 AS n, width, height, CAST(8 + p_size % 6 AS BIGINT) AS zoom FROM ({CATALOG})"


def _box(spark, sf_dir) -> DataFrame:
    k = F.col("path")
    return catalog(spark, sf_dir).select(k, (F.lit(-12000000.0) + k % 1000 * 21000.0).alias("w"), (F.lit(9000000.0) - k % 777 * 19000.0).alias("n"), "width", "height", (8 + F.col("p_size") % 6).cast("long").alias("zoom"))


_CLAMPED = "CAST(greatest(0, least(floor({} / (156543.03392804097 / power(2.0, zoom) * 256)), power(2, zoom) - 1)) AS BIGINT)"


@query(f"SELECT path, {_CLAMPED.format('(3 * w + 20037508.342789244)')} AS tile_col, {_CLAMPED.format('(20037508.342789244 - 3 * n)')} AS tile_row FROM ({_BOX})")
def tile_index(spark, sf_dir):
    """Points thrice as far out, so that some are beyond the matrix."""
    cell = F.lit(grid.CELL_0) / F.pow(F.lit(2.0), F.col("zoom"))
    col, row = grid.tile_index(3 * F.col("w"), 3 * F.col("n"), cell)
    return _box(spark, sf_dir).select("path", col.alias("tile_col"), row.alias("tile_row"))


def _align_sql(levels: int) -> str:
    e = repr(grid.EXTENT)
    return f"""WITH b AS (SELECT *, 156543.03392804097 / power(2.0, zoom) AS cell, 156543.03392804097 / power(2.0, zoom - {levels}) * 256 AS side FROM ({_BOX})),
m AS (SELECT *, power(2, zoom - {levels}) - 1 AS top FROM b),
t AS (SELECT *, greatest(0, least(floor((w + {e}) / side), top)) AS c0, greatest(0, least(floor(({e} - n) / side), top)) AS r0, greatest(0, least(floor((w + width * cell + {e}) / side), top)) AS c1, greatest(0, least(floor(({e} - (n - height * cell)) / side), top)) AS r1 FROM m),
g AS (SELECT *, -{e} + c0 * side AS west, {e} - r0 * side AS north, -{e} + (c1 + 1) * side AS east, {e} - (r1 + 1) * side AS south FROM t)
SELECT path, zoom, round(cell, 6) AS res, round(west, 4) AS west, round(north, 4) AS north, CAST(greatest(1, round_even((east - west) / cell, 0)) AS BIGINT) AS width, CAST(greatest(1, round_even((north - south) / cell, 0)) AS BIGINT) AS height FROM g"""


def _align(spark, sf_dir, levels: int) -> DataFrame:
    cell = F.lit(grid.CELL_0) / F.pow(F.lit(2.0), F.col("zoom"))
    out = grid.aligned_grid(F.col("w"), F.col("n"), F.col("w") + F.col("width") * cell, F.col("n") - F.col("height") * cell, cell, F.col("zoom"), levels)
    digits = {"res": 6, "west": 4, "north": 4}
    return _box(spark, sf_dir).select("path", *((F.round(c, digits[k]) if k in digits else c).alias(k) for k, c in out.items()))


@query(_align_sql(0))
def web_align(spark, sf_dir):
    return _align(spark, sf_dir, 0)


@query(_align_sql(2))
def aligned_levels(spark, sf_dir):
    return _align(spark, sf_dir, 2)


@query("SELECT tms.zoom, tms.cell_size FROM (SELECT CAST(z AS INTEGER) AS zoom, round(156543.03392804097 / power(2.0, z), 9) AS cell_size FROM range(0, 31) t(z)) tms")
def tms_levels(spark, sf_dir):
    return grid.tms_table(spark).select("zoom", F.round("cell_size", 9).alias("cell_size"))


# Validation ------------------------------------------------------------------

HEADERS = f"""SELECT path, l AS level, CAST(ceil(width / power(2.0, l)) AS BIGINT) AS width, CAST(ceil(height / power(2.0, l)) AS BIGINT) AS height,
CASE WHEN p_size % 11 = 0 THEN CAST(ceil(width / power(2.0, l)) AS BIGINT) ELSE block END AS block_w, block AS block_h,
CASE WHEN l = 0 THEN 0 WHEN p_size % 13 = 0 AND l = 2 THEN 1 ELSE CAST(power(2, l) AS BIGINT) END AS decimation,
16 + l * 200 + CASE WHEN p_size % 7 = 0 THEN 400 ELSE 0 END - CASE WHEN p_size % 5 = 0 AND l = 1 THEN 300 ELSE 0 END AS ifd_offset,
3000 + (9 - l) * 10000 - CASE WHEN p_size % 17 = 0 AND l = 1 THEN 20000 ELSE 0 END AS first_data
FROM (SELECT *, {_LEVELS} - CASE WHEN p_size % 4 = 0 THEN {_LEVELS} ELSE 0 END AS n FROM ({CATALOG})), LATERAL (SELECT unnest(range(0, n + 1)) AS l)"""


def catalog_ifds(spark, sf_dir) -> DataFrame:
    n, size, l = grid.overview_count(F.col("width"), F.col("height"), F.col("block")), F.col("p_size"), F.col("level")
    rows = catalog(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.when(size % 4 == 0, 0).otherwise(n).cast("long"))))
    side = lambda c: F.ceil(F.col(c) / F.pow(F.lit(2.0), l)).cast("long")
    return rows.select(
        "path", "level", side("width").alias("width"), side("height").alias("height"),
        F.when(size % 11 == 0, side("width")).otherwise(F.col("block")).cast("long").alias("block_w"), F.col("block").cast("long").alias("block_h"),
        F.when(l == 0, 0).when((size % 13 == 0) & (l == 2), 1).otherwise(F.pow(F.lit(2.0), l)).cast("long").alias("decimation"),
        (16 + l * 200 + F.when(size % 7 == 0, 400).otherwise(0) - F.when((size % 5 == 0) & (l == 1), 300).otherwise(0)).cast("long").alias("ifd_offset"),
        (3000 + (9 - l) * 10000 - F.when((size % 17 == 0) & (l == 1), 20000).otherwise(0)).cast("long").alias("first_data"),
    )


def catalog_blocks(spark, sf_dir) -> DataFrame:
    """Three blocks for each directory, the first of them sparse."""
    return catalog_ifds(spark, sf_dir).select("path", "level", F.lit(0).alias("block_y"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("block_x"), "first_data").select("path", "level", "block_y", "block_x", F.when(F.col("block_x") == 0, 0).otherwise(F.col("first_data") + F.col("block_x") * 10 - 10).cast("long").alias("offset"))


@query(f"SELECT path, level, first_data AS first_offset FROM ({HEADERS})")
def first_block_offset(spark, sf_dir):
    return validate.first_block_offsets(catalog_blocks(spark, sf_dir))


@query(f"SELECT path, level, ifd_offset, coalesce(ifd_offset < lag(ifd_offset) OVER (PARTITION BY path ORDER BY level), false) AS backwards FROM ({HEADERS})")
def ifd_order(spark, sf_dir):
    return pixels.directory_rules(catalog_ifds(spark, sf_dir))


def _checked_rows(spark, sf_dir, strict: bool) -> DataFrame:
    levels = validate.level_arrays(catalog_ifds(spark, sf_dir).drop("first_data"), catalog_blocks(spark, sf_dir))
    kind = F.when(F.col("path") % 19 == 0, "PNG").otherwise("GTiff")
    ghost = F.create_map(F.lit("KNOWN_INCOMPATIBLE_EDITION"), F.when(F.col("path") % 23 == 0, "YES").otherwise("NO"))
    rows = levels.select("path", kind.alias("driver"), "levels", ghost.alias("ghost"), (F.col("path") % 29 == 0).alias("has_sidecar"))
    return validate.validate(rows, strict)


def _checked(spark, sf_dir, strict: bool) -> DataFrame:
    return _checked_rows(spark, sf_dir, strict).select("path", "valid", F.size("errors").cast("long").alias("n_errors"), F.size("warnings").cast("long").alias("n_warnings"))


def _checked_sql(strict: bool) -> str:
    return f"""WITH h AS ({HEADERS}), x AS (SELECT *, lag(ifd_offset) OVER o AS above, lead(first_data) OVER o AS below, lead(level) OVER o AS deeper, max(level) OVER (PARTITION BY path) AS last, lead(decimation) OVER o AS next_dec FROM h WINDOW o AS (PARTITION BY path ORDER BY level)),
e AS (SELECT path,
  sum(CASE WHEN level = 0 AND width > 512 AND height > 512 AND block_w = width THEN 1 ELSE 0 END) + sum(CASE WHEN level = 0 AND ifd_offset > 300 THEN 1 ELSE 0 END)
  + max(CASE WHEN level > 0 AND next_dec < decimation THEN 1 ELSE 0 END) + sum(CASE WHEN level > 0 AND decimation <= 1 THEN 1 ELSE 0 END) + sum(CASE WHEN ifd_offset < above THEN 1 ELSE 0 END)
  + max(CASE WHEN level = last AND first_data < ifd_offset THEN 1 ELSE 0 END) + sum(CASE WHEN deeper IS NOT NULL AND first_data < below THEN 1 ELSE 0 END)
  + sum(CASE WHEN level > 0 AND width > 512 AND height > 512 AND block_w = width THEN 1 ELSE 0 END) + CASE WHEN path % 23 = 0 THEN 1 ELSE 0 END + CASE WHEN path % 29 = 0 THEN 1 ELSE 0 END AS e,
  max(CASE WHEN level = 0 AND width > 512 AND height > 512 AND last = 0 THEN 1 ELSE 0 END) AS w FROM x GROUP BY path),
f AS (SELECT path, CASE WHEN path % 19 = 0 THEN 1 ELSE e END AS e, CASE WHEN path % 19 = 0 THEN 0 ELSE w END AS w FROM e)
SELECT path, {"e = 0 AND w = 0" if strict else "e = 0"} AS valid, CAST(e AS BIGINT) AS n_errors, CAST(w AS BIGINT) AS n_warnings FROM f"""


@query(_checked_sql(False))
def validate_errors(spark, sf_dir):
    return _checked(spark, sf_dir, False)


@query(_checked_sql(True))
def validate_strict(spark, sf_dir):
    return _checked(spark, sf_dir, True)


_MESSAGES = f"""WITH h AS ({HEADERS}), x AS (SELECT *, lag(ifd_offset) OVER o AS above, lead(first_data) OVER o AS below, lead(level) OVER o AS deeper, max(level) OVER (PARTITION BY path) AS last, lead(decimation) OVER o AS next_dec FROM h WINDOW o AS (PARTITION BY path ORDER BY level)),
m AS (
  SELECT path, 1 AS a, 0 AS b, 'overviews are in an external .ovr file' AS t FROM x WHERE level = 0 AND path % 29 = 0
  UNION ALL SELECT path, 2, 0, 'the raster is larger than 512 x 512 and not tiled' FROM x WHERE level = 0 AND width > 512 AND height > 512 AND block_w = width
  UNION ALL SELECT path, 3, 0, 'the first directory begins at ' || ifd_offset || ', beyond 300' FROM x WHERE level = 0 AND ifd_offset > 300
  UNION ALL SELECT path, 4, 0, 'the file had an optimized layout that a later edit broke' FROM x WHERE level = 0 AND path % 23 = 0
  UNION ALL SELECT DISTINCT path, 5, 0, 'overviews are not sorted by size' FROM x WHERE level > 0 AND next_dec < decimation
  UNION ALL SELECT path, 6, level * 2, 'overview ' || (level - 1) || ' has the decimation ' || decimation FROM x WHERE level > 0 AND decimation <= 1
  UNION ALL SELECT path, 6, level * 2 + 1, 'the directory of overview ' || (level - 1) || ' begins at ' || ifd_offset || ', before that of ' || CASE WHEN level = 1 THEN 'the full resolution' ELSE 'overview ' || (level - 2) END || ' at ' || above FROM x WHERE ifd_offset < above
  UNION ALL SELECT path, 7, 0, 'data of level ' || level || ' begin at ' || first_data || ', before the last directory at ' || ifd_offset FROM x WHERE level = last AND first_data < ifd_offset
  UNION ALL SELECT path, 8, -level, 'data of overview ' || (level - 1) || ' begin before those of overview ' || (deeper - 1) FROM x WHERE level > 0 AND first_data < below
  UNION ALL SELECT path, 9, 0, 'data of the full resolution begin before those of overview ' || (deeper - 1) FROM x WHERE level = 0 AND first_data < below
  UNION ALL SELECT path, 10, level, 'overview ' || (level - 1) || ' is not tiled' FROM x WHERE level > 0 AND width > 512 AND height > 512 AND block_w = width
)
SELECT path, CASE WHEN path % 19 = 0 THEN 'the file is not a GeoTIFF' ELSE coalesce((SELECT string_agg(t, '; ' ORDER BY a, b) FROM m WHERE m.path = h.path), '') END AS errors,
CASE WHEN path % 19 <> 0 AND width > 512 AND height > 512 AND NOT EXISTS (SELECT 1 FROM h o WHERE o.path = h.path AND o.level > 0) THEN 'the raster is larger than 512 x 512 and has no overviews' ELSE '' END AS warnings
FROM h WHERE level = 0"""


@query(_MESSAGES)
def validate_messages(spark, sf_dir):
    """The validator's messages, in its order."""
    return _checked_rows(spark, sf_dir, False).select("path", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


# Tags, bands, profiles, policy ------------------------------------------------


@query(
    """SELECT p_partkey AS path, 'OVERVIEW_RESAMPLING=NEAREST;' || CASE WHEN p_size % 3 = 0 THEN 'TILING_SCHEME_NAME=WebMercatorQuad;TILING_SCHEME_ZOOM_LEVEL=' || (p_size % 20) || ';' ELSE '' END
|| 'area=' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END || ';name=' || p_name AS tags FROM part"""
)
def tag_merge(spark, sf_dir):
    def run(batches):
        for batch in batches:
            out = []
            for path, size, name, brand, kind in zip(*(batch.column(c).to_pylist() for c in ("p_partkey", "p_size", "p_name", "p_brand", "p_type"))):
                tms = grid.WEB_MERCATOR if size % 3 == 0 else None
                tags = policy.merged_tags({"name": name, "area": brand, "OVERVIEW_RESAMPLING": "CUBIC"}, "nearest", tms, size % 20, None, {"area": kind} if size % 2 == 0 else None)
                out.append((path, ";".join(f"{k}={v}" for k, v in sorted(tags.items()))))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())], ["path", "tags"])

    return _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type").mapInArrow(run, "path long, tags string")


@query("SELECT p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN 'Image Structure' WHEN p_size % 3 = 1 THEN 'Rpc' ELSE 'Tiling Scheme V2' END AS title FROM part")
def namespace_titles(spark, sf_dir):
    raw = F.when(F.col("p_size") % 3 == 0, "IMAGE_STRUCTURE").when(F.col("p_size") % 3 == 1, "RPC").otherwise("tiling_scheme_v2")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), info.namespace_title(raw).alias("title"))


@query(
    """SELECT p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END AS n_bands, p_size % 2 = 0 AS alpha, CASE WHEN p_size % 2 = 0 THEN '1,2,3' ELSE '1,2,3' END AS colour_bands,
'1:' || p_brand || '|2:' || p_type || '|3:' || p_name AS descriptions FROM part"""
)
def band_metadata(spark, sf_dir):
    band = lambda i, interp, text: F.struct(F.lit(i).alias("band"), F.lit(interp).alias("colorinterp"), F.col(text).alias("description"))
    colours = [band(1, "red", "p_brand"), band(2, "green", "p_type"), band(3, "blue", "p_name")]
    bands = F.when(F.col("p_size") % 2 == 0, F.array(*colours, band(4, "alpha", "p_name"))).otherwise(F.array(*colours))
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), bands.alias("bands"))
    kept = F.filter("bands", lambda b: b["colorinterp"] != "alpha")
    return rows.select("path", F.size("bands").alias("n_bands"), info.has_alpha(F.col("bands")).alias("alpha"), F.array_join(info.non_alpha(F.col("bands")).cast("array<string>"), ",").alias("colour_bands"), F.array_join(F.transform(kept, lambda b: F.concat(b["band"].cast("string"), F.lit(":"), b["description"])), "|").alias("descriptions"))


@query(
    """SELECT * FROM (VALUES
('jpeg', 'JPEG', 'YCbCr', 'pixel', 512, false), ('webp', 'WEBP', NULL, 'pixel', 512, true), ('zstd', 'ZSTD', NULL, 'pixel', 512, true),
('lzw', 'LZW', NULL, 'pixel', 512, false), ('deflate', 'DEFLATE', NULL, 'pixel', 512, false), ('packbits', 'PACKBITS', NULL, 'pixel', 512, false),
('lzma', 'LZMA', NULL, 'pixel', 512, false), ('lerc', 'LERC', NULL, 'pixel', 512, true), ('lerc_deflate', 'LERC_DEFLATE', NULL, 'pixel', 512, true),
('lerc_zstd', 'LERC_ZSTD', NULL, 'pixel', 512, true), ('raw', NULL, NULL, 'pixel', 512, false)) v(profile, compress, photometric, interleave, block, rare_codec)"""
)
def profile_lookup(spark, sf_dir):
    return spark.createDataFrame(profiles.rows(), "profile string, compress string, photometric string, interleave string, block int, rare_codec boolean")


@query(
    f"""SELECT path, CASE WHEN has_nodata THEN 'nodata' WHEN alpha THEN 'alpha' WHEN mask THEN 'mask' ELSE 'all' END AS validity,
CASE WHEN NOT has_nodata AND NOT alpha AND mask THEN true ELSE false END AS writes_mask FROM (SELECT path, p_size % 3 = 0 AS has_nodata, p_size % 4 = 0 AS alpha, p_size % 5 = 0 AS mask FROM ({CATALOG}))"""
)
def mask_policy(spark, sf_dir):
    import itertools
    import warnings

    rows = []
    for nodata, alpha, mask in itertools.product((True, False), repeat=3):
        source = policy.Source(8, 8, 4 if alpha else 3, "uint8", 0.0 if nodata else None, ["red", "green", "blue"] + ["alpha"] * alpha, mask)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            plan = policy.plan(source, profiles.options_of("deflate"))
        rows.append((nodata, alpha, mask, plan.validity, plan.write_mask and not alpha))
    table = spark.createDataFrame(rows, "has_nodata boolean, alpha boolean, mask boolean, validity string, writes_mask boolean")
    size = F.col("p_size")
    flags = catalog(spark, sf_dir).select("path", (size % 3 == 0).alias("has_nodata"), (size % 4 == 0).alias("alpha"), (size % 5 == 0).alias("mask"))
    return flags.join(F.broadcast(table), ["has_nodata", "alpha", "mask"]).select("path", "validity", "writes_mask")


@query(
    """SELECT user_id % 50 AS row, CAST(hour(ts) AS BIGINT) AS col, count(value) AS n_valid, round(sum(value) / nullif(count(value), 0), 6) AS value FROM events GROUP BY 1, 2"""
)
def sparse_grid(spark, sf_dir):
    cells = _read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("row"), F.hour("ts").cast("long").alias("col"), "value")
    return _rounded(pixels.overview(cells, 1, "average"), 6)


@query(
    f"""WITH b AS (SELECT path, lon, lat FROM (SELECT path, path % 360 - 180.0 AS lon, path % 160 - 80.0 AS lat FROM ({CATALOG})))
SELECT path, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y FROM b"""
)
def mercator_points(spark, sf_dir):
    x, y = grid.mercator(F.col("path") % 360 - 180.0, F.col("path") % 160 - 80.0)
    return catalog(spark, sf_dir).select("path", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# Warping: the vectors' raster on a grid of cells of two and a half pixels ---------

_STEP = 2.5
_OUT = f"(SELECT CAST(floor((max(vec_id) + 1) / {_STEP}) AS BIGINT) AS n FROM embeddings)"
_AREAS = f"""SELECT r AS row, c AS col, value, (least(p.row + 1, (r + 1) * {_STEP}) - greatest(p.row, r * {_STEP})) * (least(p.col + 1, (c + 1) * {_STEP}) - greatest(p.col, c * {_STEP})) AS w
FROM ({VEC}) p, LATERAL (SELECT unnest([CAST(floor(p.row / {_STEP}) AS BIGINT), CAST(floor(p.row / {_STEP}) AS BIGINT) + 1]) AS r), LATERAL (SELECT unnest([CAST(floor(p.col / {_STEP}) AS BIGINT), CAST(floor(p.col / {_STEP}) AS BIGINT) + 1]) AS c)
WHERE r * {_STEP} < p.row + 1 AND c * {_STEP} < p.col + 1 AND r < {_OUT} AND c < 25"""
_TENT = f"""SELECT o.row, o.col, value, greatest(0, 1 - abs(p.row + 0.5 - (o.row + 0.5) * {_STEP}) / {_STEP}) * greatest(0, 1 - abs(p.col + 0.5 - (o.col + 0.5) * {_STEP}) / {_STEP}) AS w
FROM ({VEC}) p, LATERAL (SELECT unnest(range(-2, 3)) + CAST(floor(p.row / {_STEP}) AS BIGINT) AS row) r, LATERAL (SELECT unnest(range(-2, 3)) + CAST(floor(p.col / {_STEP}) AS BIGINT) AS col) c,
LATERAL (SELECT r.row AS row, c.col AS col) o WHERE o.row BETWEEN 0 AND {_OUT} - 1 AND o.col BETWEEN 0 AND 24"""
_WARP_SQL = {
    "nearest": f"SELECT r AS row, c AS col, round(value, 6) AS value FROM range(0, {_OUT}) a(r), range(0, 25) b(c), ({VEC}) p WHERE p.row = floor((r + 0.5) * {_STEP}) AND p.col = floor((c + 0.5) * {_STEP})",
    "average": f"SELECT row, col, round(sum(w * value) / sum(w), 6) AS value FROM ({_AREAS}) GROUP BY 1, 2",
    "rms": f"SELECT row, col, round(sqrt(sum(w * value * value) / sum(w)), 6) AS value FROM ({_AREAS}) GROUP BY 1, 2",
    "sum": f"SELECT row, col, round(sum(w * value), 6) AS value FROM ({_AREAS}) GROUP BY 1, 2",
    "bilinear": f"SELECT row, col, round(sum(w * value) / sum(w), 6) AS value FROM ({_TENT}) WHERE w > 0 GROUP BY 1, 2",
}


def _warp_query(method: str, sql: str):
    def run(spark, sf_dir):
        height = _read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
        cells = warp.output_grid(spark, 25, int(height / _STEP))
        places = warp.source_place(cells, (_STEP, 0.0, 0.0, 0.0, _STEP, 0.0), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
        return _rounded(warp.warp(vector_pixels(spark, sf_dir), places, method, scale=(_STEP, _STEP)), 6)

    query(sql, f"warp_{method}")(run)


for _m, _sql in _WARP_SQL.items():
    _warp_query(_m, _sql)


# The same in blocks, as files are translated -------------------------------------


def vector_blocks(spark, sf_dir) -> DataFrame:
    return tiles.from_pixels(vector_pixels(spark, sf_dir).withColumn("band", F.lit(1)), 0, 32, 1, "float64")


def _unblocked(blocks: DataFrame, width: int, height: int) -> DataFrame:
    return _rounded(tiles.to_pixels(blocks, 32, 1, "float64", width, height).select("row", "col", "value"), 6)


def _blocks_query(name: str, sql: str, overview: bool):
    def run(spark, sf_dir):
        height = _read(spark, sf_dir, "embeddings").count()  # ids are dense
        if overview:
            made = resample.kernel_overview(vector_blocks(spark, sf_dir), 32, 1, "float64", (height, 64), 2, name, 1)
            return _unblocked(made, 32, -(-height // 2)).where("value is not null")
        out = int(height / _STEP), 25
        place = resample.placing((_STEP, 0.0, 0.0, 0.0, _STEP, 0.0), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
        made = resample.resample(vector_blocks(spark, sf_dir), 32, 1, "float64", (height, 64), out, place, name, (_STEP, _STEP))
        return _unblocked(made, out[1], out[0]).where("value is not null")

    query(f"SELECT row, col, value FROM ({sql}) WHERE value IS NOT NULL", f"blocks_{'overview' if overview else 'warp'}_{name}")(run)


for _m in ("cubic", "lanczos", "gauss"):
    _blocks_query(_m, _kernel_sql(_m, 2), True)
for _m, _sql in _WARP_SQL.items():
    _blocks_query(_m, _sql, False)
