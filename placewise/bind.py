"""Shapes the operators need, derived from the star-schema tables of a data folder.

Every shape is a plain DataFrame over the folder's parquet files; each has its SQL twin in
``placewise.checks.sqlbind``. Measures are summed as DECIMAL so that results do not depend on the order
in which partial sums meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placewise.functions.grid import Grid

#: The 10-degree test grid: 36 columns by 18 rows.
GRID = Grid.world(10.0)
CELL_COUNT = GRID.width * GRID.height
MONEY = "decimal(18,2)"
#: The years that orders have, at every scale.
ORDER_YEARS = list(range(1995, 2002))
_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """The parquet tables of one folder and the shapes bound onto them.

    ``nation`` and ``region`` are fixed at 25 and 5 rows at every scale, so they may be broadcast.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        """The table; its schema is looked up in the files once per folder."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    # --- cells ---------------------------------------------------------------------------------

    def points(self) -> DataFrame:
        key = F.col("c_custkey")
        return self["customer"].select(key.alias("id"), point_lon(key).alias("lon"), point_lat(key).alias("lat"))

    def part_cells(self) -> DataFrame:
        return with_cell(self["lineitem"], "l_partkey")

    def layer_temp(self) -> DataFrame:
        return self.part_cells().groupBy("row", "col").agg((F.avg("l_quantity") * 1.5 - 30.0).alias("value"))

    def layer_water(self) -> DataFrame:
        return self.part_cells().groupBy("row", "col").agg((money_mean("l_extendedprice") / 35.0).alias("value"))

    def layer_pop(self) -> DataFrame:
        cells = with_cell(self["customer"], "c_custkey")
        return cells.groupBy("row", "col").agg(money_sum(F.abs("c_acctbal")).alias("value"))

    def layer_elev(self) -> DataFrame:
        cells = with_cell(self["part"], "p_partkey")
        return cells.groupBy("row", "col").agg((F.avg("p_size") - 25.0).alias("value"))

    def layer_gdp(self) -> DataFrame:
        cells = with_cell(self["orders"], "o_custkey").withColumn("year", F.year("o_orderdate"))
        return cells.groupBy("row", "col", "year").agg((money_mean("o_totalprice") / 6.0).alias("value"))

    def layers(self) -> DataFrame:
        """temp, water and pop in long form: axis, row, col, value. One scan feeds both line-item layers."""
        lines = self.part_cells().groupBy("row", "col").agg(
            (F.avg("l_quantity") * 1.5 - 30.0).alias("temp"), (money_mean("l_extendedprice") / 35.0).alias("water")
        )
        long = lines.unpivot(["row", "col"], ["temp", "water"], "axis", "value").select("axis", "row", "col", "value")
        return long.unionByName(self.layer_pop().select(F.lit("pop").alias("axis"), "row", "col", "value"))

    def cube(self) -> DataFrame:
        cells = self.part_cells().withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})
        return cells.groupBy("row", "col", "year", "month").agg(
            F.min("l_quantity").alias("tmin"), F.max("l_quantity").alias("tmax"), F.sum("l_quantity").alias("ppt")
        )

    def crop_cells(self) -> DataFrame:
        cells = self.part_cells().withColumn("crop", (F.col("l_suppkey") % 46).cast("int"))
        return cells.groupBy("crop", "row", "col").agg(F.sum("l_quantity").alias("value"))

    def hazard_cells(self) -> DataFrame:
        """hazard (1..7), row, col, intensity."""
        cells = self.part_cells().withColumn("hazard", F.col("l_linenumber"))
        return cells.groupBy("hazard", "row", "col").agg(money_mean("l_discount").alias("intensity"))

    # --- points --------------------------------------------------------------------------------

    def plants(self) -> DataFrame:
        key = F.col("p_partkey")
        nation = F.broadcast(self["nation"].select("n_nationkey", F.col("n_name").alias("country")))
        return (
            self["part"]
            .withColumns({"lon": point_lon(key), "lat": point_lat(key), "_nation": (key % 25).cast("int")})
            .join(nation, F.col("_nation") == F.col("n_nationkey"), "left")
            .select(key.alias("id"), "lon", "lat", F.col("p_retailprice").alias("capacity"), F.col("p_type").alias("fuel"), "country")
        )

    def speedtests(self) -> DataFrame:
        """id, tile (WKT of a 0.1-degree square), kbps."""
        key = F.col("event_id")
        west, south = point_lon(key), point_lat(key)
        corner = lambda dx, dy: F.concat((west + dx).cast("string"), F.lit(" "), (south + dy).cast("string"))
        ring = F.concat_ws(", ", corner(0, 0), corner(0.1, 0), corner(0.1, 0.1), corner(0, 0.1), corner(0, 0))
        return self["events"].select(
            key.alias("id"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("tile"),
            (F.col("value") * 2000.0).alias("kbps"), west.alias("west"), south.alias("south"),
        )

    # --- zones and countries -------------------------------------------------------------------

    def zones_adm1(self) -> DataFrame:
        """One 72 by 36 degree rectangle per nation: 25 zones tiling the globe."""
        west = F.lit(-180.0) + F.col("n_nationkey") % 5 * 72.0
        north = F.lit(90.0) - F.floor(F.col("n_nationkey") / 5) * 36.0
        return self["nation"].select(
            F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), iso3("n_nationkey").alias("iso3"),
            F.concat(F.lit("REG"), F.col("n_regionkey")).alias("admin"),
            F.array(rectangle(west, north, 72.0, 36.0)).alias("rings"),
        )

    def zones_adm0(self) -> DataFrame:
        """One 72-degree strip per region: exactly the union of its nations."""
        west = F.lit(-180.0) + F.col("r_regionkey") * 72.0
        return self["region"].select(
            F.col("r_regionkey").alias("ord"), F.concat(F.lit("REGION_"), F.col("r_regionkey")).alias("name"),
            F.concat(F.lit("R0"), F.col("r_regionkey")).alias("iso3"),
            F.array(rectangle(west, F.lit(90.0), 72.0, 180.0)).alias("rings"),
        )

    def triangles(self) -> DataFrame:
        """One overlapping triangle per supplier."""
        key = F.col("s_suppkey")
        a, b = point_lon(key), point_lat(key)
        pts = [(a, b), (a + 33.5, b - 21.25), (a - 17.75, b - 40.5), (a, b)]
        ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in pts])
        return self["supplier"].select(key.alias("ord"), F.array(ring).alias("rings"))

    def indicator(self) -> DataFrame:
        """name, iso3, year, value: mean order value per nation and year.

        Orders collapse to one row per customer and year before they meet the customers.
        """
        per_customer = (
            self["orders"].groupBy("o_custkey", F.year("o_orderdate").alias("year"))
            .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("total"), F.count(F.lit(1)).alias("n"))
        )
        nation = F.broadcast(self["nation"])
        return (
            per_customer.join(self["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("name"), iso3("n_nationkey").alias("iso3"), "n_nationkey", "year")
            .agg((F.sum("total").cast("double") / F.sum("n")).alias("value"))
        )

    def brush(self) -> DataFrame:
        """seq, op, level, cx, cy, r: paint/erase strokes at level 8."""
        return self["events"].select(
            F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "error", F.lit("erase")).otherwise(F.lit("paint")).alias("op"),
            F.lit(8).alias("level"),
            (F.col("user_id") * 37 % 256).cast("int").alias("cx"),
            (F.col("event_id") * 101 % 256).cast("int").alias("cy"),
            (F.col("event_id") % 4).cast("int").alias("r"),
        )

    def quad_events(self) -> DataFrame:
        """seq, op, level, cx, cy: single-cell paint/erase events over levels 3 to 7."""
        level = (F.lit(3) + F.col("event_id") % 5).cast("int")
        return self["events"].select(
            F.col("event_id").alias("seq"),
            F.when(F.col("event_id") % 3 == 0, F.lit("erase")).otherwise(F.lit("paint")).alias("op"),
            level.alias("level"),
            (F.col("user_id") * 37 % F.expr("shiftleft(1L, cast(3 + event_id % 5 as int))")).cast("int").alias("cx"),
            (F.col("event_id") * 101 % F.expr("shiftleft(1L, cast(3 + event_id % 5 as int))")).cast("int").alias("cy"),
        )

    def artefacts(self) -> DataFrame:
        """path: archive names, static (P), yearly (O) and projected (F)."""
        status, year = F.lower("o_orderstatus"), F.year("o_orderdate").cast("string")
        suffix = (
            F.when(status == "f", F.concat(F.lit("_ssp585_"), year)).when(status == "o", F.concat(F.lit("_"), year)).otherwise(F.lit(""))
        )
        return self["orders"].select(F.concat(status, F.lit("/"), status, suffix, F.lit(".pmtiles")).alias("path"))


def point_lon(key: Column) -> Column:
    return (key * 7919 % 36000).cast("double") / 100.0 - 180.0


def point_lat(key: Column) -> Column:
    return (key * 104729 % 17000).cast("double") / 100.0 - 85.0


def with_cell(df: DataFrame, key: str) -> DataFrame:
    cell = F.col(key) * 7919 % CELL_COUNT
    return df.withColumns(
        {"row": F.floor(cell / GRID.width).cast("int"), "col": (cell % GRID.width).cast("int")}
    )


def money_sum(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value.cast(MONEY)).cast("double")


def money_mean(value: Column | str) -> Column:
    name = F.col(value) if isinstance(value, str) else value
    return money_sum(name) / F.count(name)


def iso3(key: str) -> Column:
    """A three-letter code from a small integer key: 0 -> 'NAA', 1 -> 'NAB', ..."""
    k = F.col(key)
    return F.concat(F.lit("N"), F.chr(F.floor(k / 26) + 65), F.chr(k % 26 + 65))


def rectangle(west: Column, north: Column, width: float, height: float) -> Column:
    east, south = west + width, north - height
    corners = [(west, north), (east, north), (east, south), (west, south), (west, north)]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
