"""Readers: explicit schemas, permissive parsing, bad rows filtered rather than raised.

Text sources come in two steps: ``read_*`` opens the files with every column as text, ``clean_*`` turns
those columns into typed rows. The second step works on any DataFrame with the same columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.encode import is_country, number_or_null
from placewise.functions.geometry import RINGS_TYPE, ring_centroid, wkt_ring
from placewise.sources.records import json_records


def _csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """The named columns as text, found by header name, and line_no; a missing column reads as NULL."""
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in header)).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    present = [(F.col(f"`{c}`") if c in header else F.lit(None).cast("string")).alias(c) for c in columns]
    return raw.select(*present, file_order().alias("line_no"))


def file_order() -> Column:
    """An orderable line position: file, start of the split, row within the split.

    A plain running id would not do, because Spark packs large splits first.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
    )


# --- layers and cubes --------------------------------------------------------------------------


def read_cells(spark: SparkSession, path: str, layer: str | None = None, years: list[int] | None = None) -> DataFrame:
    """Stored cells; layer and year become partition filters, years outside the bands are skipped."""
    return select_cells(spark.read.parquet(path), layer, years)


def select_cells(cells: DataFrame, layer: str | None = None, years: list[int] | None = None) -> DataFrame:
    if layer is not None:
        cells = cells.where(F.col("layer") == layer)
    if years is not None:
        known = [y for y in years if dims.FIRST_BAND_YEAR <= y <= dims.LAST_BAND_YEAR]
        cells = cells.where(F.col("year").isin(known))
    return cells


def read_cube(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Monthly values of several variables, only years that have all of them."""
    return paired_cube(spark.read.parquet(path), variables)


def paired_cube(cube: DataFrame, variables: list[str]) -> DataFrame:
    wanted = cube.where(F.col("var").isin(variables))
    complete = wanted.select("year", "var").distinct().groupBy("year").count().where(F.col("count") == len(variables))
    return wanted.join(complete.select("year"), "year", "left_semi")


def read_crops(spark: SparkSession, path: str, crops: list[int]) -> DataFrame:
    """Crop cells of the listed crops; a crop without files simply has no rows."""
    return select_crops(spark.read.parquet(path), crops)


def select_crops(cells: DataFrame, crops: list[int]) -> DataFrame:
    return cells.where(F.col("crop").isin(crops))


# --- points ------------------------------------------------------------------------------------


def read_plants(spark: SparkSession, path: str) -> DataFrame:
    return clean_plants(_csv(spark, path, ["country_long", "primary_fuel", "latitude", "longitude", "capacity_mw"]))


def clean_plants(raw: DataFrame) -> DataFrame:
    """Rows whose position or capacity does not parse are dropped."""
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    typed = raw.withColumns({"lat": number("latitude"), "lon": number("longitude"), "capacity": number("capacity_mw")})
    return typed.na.drop(subset=["lat", "lon", "capacity"]).withColumnsRenamed(
        {"country_long": "country", "primary_fuel": "fuel"}
    ).drop("latitude", "longitude", "capacity_mw")


def read_volcanoes(spark: SparkSession, path: str) -> DataFrame:
    return clean_volcanoes(_csv(spark, path, ["Latitude", "Longitude", "Last_Eruption_Year"]))


def clean_volcanoes(raw: DataFrame) -> DataFrame:
    """Positions must parse; a year that does not parse counts as 0."""
    year = F.coalesce(F.col("Last_Eruption_Year").try_cast("double").try_cast("int"), F.lit(0))
    typed = raw.withColumns({"lat": F.col("Latitude").try_cast("double"), "lon": F.col("Longitude").try_cast("double"), "last_year": year})
    return typed.na.drop(subset=["lat", "lon"]).drop("Latitude", "Longitude", "Last_Eruption_Year")


def read_runup(spark: SparkSession, path: str) -> DataFrame:
    return clean_runup(_csv(spark, path, ["POINT_X", "POINT_Y", "ari500"], sep=";"))


def clean_runup(raw: DataFrame) -> DataFrame:
    """Longitudes past 180 come back by one turn."""
    x = F.col("POINT_X").try_cast("double")
    typed = raw.withColumns({
        "lon": F.when(x > 180, x - 360).otherwise(x), "lat": F.col("POINT_Y").try_cast("double"), "runup": F.col("ari500").try_cast("double"),
    })
    return typed.na.drop(subset=["lon", "lat", "runup"]).drop("POINT_X", "POINT_Y", "ari500")


def read_speedtests(spark: SparkSession, path: str) -> DataFrame:
    return clean_speedtests(spark.read.parquet(path))


def clean_speedtests(raw: DataFrame) -> DataFrame:
    """Adds the tile centroid; files that carry only a quadkey are refused."""
    if not {"tile", "avg_d_kbps"} <= set(raw.columns):
        raise ValueError("speed tests need the columns tile (WKT) and avg_d_kbps")
    centre = raw.withColumn("_c", ring_centroid(wkt_ring(F.col("tile"))))
    return centre.select("*", "_c.lon", "_c.lat").drop("_c", "tile")


# --- tables by country -------------------------------------------------------------------------


def read_deaths(spark: SparkSession, path: str) -> DataFrame:
    columns = ["Entity", "Code", "Year", *[c for c, _h in dims.DEATH_COLUMNS]]
    return clean_deaths(_csv(spark, path, columns))


def clean_deaths(raw: DataFrame) -> DataFrame:
    """code, column, hazard, year, deaths; blanks count 0 and the last line per code, column, year stays."""
    pairs = ", ".join(f"'{c}', '{h}', `{c}`" for c, h in dims.DEATH_COLUMNS)
    long = raw.select(
        F.trim("Code").alias("code"), F.col("Year").try_cast("int").alias("year"), "line_no",
        F.expr(f"stack({len(dims.DEATH_COLUMNS)}, {pairs}) AS (column, hazard, _d)"),
    ).where(F.col("year").isNotNull() & (F.coalesce("code", F.lit("")) != ""))
    deaths = F.coalesce(F.col("_d").try_cast("double"), F.lit(0.0))
    return long.groupBy("code", "column", "hazard", "year").agg(F.max_by(deaths, "line_no").alias("deaths"))


def read_population(spark: SparkSession, path: str) -> DataFrame:
    return clean_population(_csv(spark, path, ["year", "code", "population_historical"]))


def clean_population(raw: DataFrame) -> DataFrame:
    """code, population of 2020; aggregate codes are left out, the last line per code stays."""
    code = F.trim("code")
    kept = raw.where((F.col("year").try_cast("int") == 2020) & (code != "") & ~code.startswith("OWID_"))
    typed = kept.select(code.alias("code"), F.col("population_historical").try_cast("double").alias("population"), "line_no")
    return typed.where(F.col("population").isNotNull()).groupBy("code").agg(F.max_by("population", "line_no").alias("population"))


SHDI_TEXT = ["level", "GDLCODE", "country", "region", "year", "shdi", "healthindex", "edindex", "incindex", "lifexp", "esch", "gnic"]
SHDI_FIELDS = {"shdi": "shdi", "healthindex": "health", "edindex": "education", "incindex": "income", "lifexp": "lifexp", "esch": "esch_yrs", "gnic": "gnic"}


def read_shdi(spark: SparkSession, path: str) -> DataFrame:
    return clean_shdi(_csv(spark, path, SHDI_TEXT))


def clean_shdi(raw: DataFrame) -> DataFrame:
    """Subnational rows; '.' and blank values are NULL, rows without an index are dropped."""
    rows = raw.where((F.col("level") == "Subnat") & (F.coalesce("GDLCODE", F.lit("")) != ""))
    typed = rows.select(
        F.col("GDLCODE").alias("code"), "country", "region", F.coalesce("year", F.lit("0")).try_cast("int").alias("year"),
        *[number_or_null(F.col(source)).alias(target) for source, target in SHDI_FIELDS.items()], "line_no",
    )
    return typed.where(F.col("year").isNotNull() & F.col("shdi").isNotNull())


def read_cpi(spark: SparkSession, path: str) -> DataFrame:
    return clean_cpi(_csv(spark, path, ["year", "country", "score"]))


def clean_cpi(raw: DataFrame) -> DataFrame:
    """year, country, score; bad rows are skipped and the last line per year and country stays."""
    typed = raw.select(F.trim("year").try_cast("int").alias("year"), F.trim("country").alias("country"), F.trim("score").try_cast("double").alias("score"), "line_no")
    return typed.na.drop(subset=["year", "country", "score"]).groupBy("year", "country").agg(F.max_by("score", "line_no").alias("score"))


def read_risk_index(spark: SparkSession, path: str) -> DataFrame:
    return clean_risk_index(_csv(spark, path, ["COUNTRY", "INFORM RISK"]))


def clean_risk_index(raw: DataFrame) -> DataFrame:
    """country, risk."""
    typed = raw.select(F.trim("COUNTRY").alias("country"), F.col("`INFORM RISK`").try_cast("double").alias("risk"), "line_no")
    kept = typed.na.drop(subset=["country", "risk"]).where(F.col("country") != "(a-z)")
    return kept.groupBy("country").agg(F.max_by("risk", "line_no").alias("risk"))


INDICATOR_ENTRY = "struct<countryiso3code:string,country:struct<value:string>,date:string,value:string>"


def read_indicator(spark: SparkSession, path: str) -> DataFrame:
    """iso3, year, value from '[meta, [entry, ...]]' files, one document per file; large files are read by many tasks."""
    return indicator_by_year(clean_indicator(_stored_entries(spark, path)))


def read_indicator_latest(spark: SparkSession, path: str) -> DataFrame:
    return indicator_by_name(clean_indicator(_stored_entries(spark, path)))


def _stored_entries(spark: SparkSession, path: str) -> DataFrame:
    records = json_records(spark, path, lists=2, objects=0)
    return records.select(global_place().alias("pos"), F.from_json("doc", INDICATOR_ENTRY).alias("_e"))


def global_place() -> Column:
    """A record's place over all files: by file, then by its place there."""
    return F.col("file_no") * (1 << 32) + F.col("pos")


def indicator_entries(docs: DataFrame) -> DataFrame:
    """Entries of documents held one per row in ``doc``, with their position; a document of another shape has none."""
    entries = F.from_json(F.get_json_object("doc", "$[1]"), f"array<{INDICATOR_ENTRY}>")
    return clean_indicator(docs.select(F.posexplode(entries).alias("pos", "_e")))


def clean_indicator(entries: DataFrame) -> DataFrame:
    return entries.select(
        "pos", F.trim("_e.countryiso3code").alias("iso3"), F.col("_e.country.value").alias("name"),
        F.col("_e.date").try_cast("int").alias("year"), F.col("_e.value").try_cast("double").alias("value"),
    ).where(is_country(F.col("iso3")) & F.col("value").isNotNull())


def indicator_by_year(entries: DataFrame) -> DataFrame:
    dated = entries.where(F.col("year").isNotNull())
    return dated.groupBy("iso3", "year").agg(F.max_by("value", "pos").alias("value"))


def indicator_by_name(entries: DataFrame) -> DataFrame:
    """name, value without a year: the last entry of a name stays."""
    named = entries.where(F.coalesce("name", F.lit("")) != "")
    return named.groupBy("name").agg(F.max_by("value", "pos").alias("value"))


def read_indicator_xml(spark: SparkSession, path: str) -> DataFrame:
    """name, value from the indicator's XML download (one <wb:data> element per record)."""
    reader = spark.read.format("xml").option("rowTag", "data").option("ignoreNamespace", True).option("ignoreSurroundingSpaces", True)
    raw = reader.schema("country string, value string").load(path)
    return clean_indicator_xml(raw.select("country", "value", file_order().alias("line_no")))


def indicator_xml_records(docs: DataFrame) -> DataFrame:
    """country, value of XML records held one per row in ``doc``."""
    return docs.select(F.from_xml("doc", "country string, value string").alias("_r"), "line_no").select("_r.*", "line_no")


def clean_indicator_xml(raw: DataFrame) -> DataFrame:
    typed = raw.select(F.col("country").alias("name"), F.trim("value").try_cast("double").alias("value"), "line_no").where(
        (F.coalesce("name", F.lit("")) != "") & F.col("value").isNotNull()
    )
    return typed.groupBy("name").agg(F.max_by("value", "line_no").alias("value"))


# --- freedom sheets ------------------------------------------------------------------------------


def read_fiw_wide(spark: SparkSession, path: str) -> DataFrame:
    """The wide ratings sheet, exported as CSV with its two header rows."""
    labels = [(c or "").strip() for c in spark.read.csv(path).first()]
    columns = [f"c{i}" for i in range(len(labels))]
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("mode", "PERMISSIVE").csv(path)
    return clean_fiw_wide(raw, dict(zip(columns, labels)))


def fiw_editions(labels: dict[str, str]) -> dict[int, tuple[str, str]]:
    """Review year -> (political rights column, civil liberties column) from the edition labels."""
    columns = list(labels)
    years = {}
    for i, column in enumerate(columns[:-1]):
        digits = re.findall(r"\d{4}", labels[column] or "") if i else []
        if digits:
            years[int(digits[-1]) - 1] = (column, columns[i + 1])
    return years


def clean_fiw_wide(raw: DataFrame, labels: dict[str, str]) -> DataFrame:
    """year, country, fiw (0..100, one decimal): the sheet unpivoted, header rows and '-' left out."""
    editions = fiw_editions(labels)
    country = list(labels)[0]
    stacked = ", ".join(f"{year}, `{pr}`, `{cl}`" for year, (pr, cl) in editions.items())
    long = raw.select(F.trim(F.col(country)).alias("country"), F.expr(f"stack({len(editions)}, {stacked}) AS (year, _pr, _cl)"))
    rating = lambda c: F.trim(F.col(c)).try_cast("double")
    score = F.bround(freedom_score(rating("_pr"), rating("_cl")), 1)
    return long.select("year", "country", score.alias("fiw")).where(F.col("fiw").isNotNull() & (F.coalesce("country", F.lit("")) != ""))


def freedom_score(rights: Column, liberties: Column) -> Column:
    """Two 1 (free) to 7 ratings to 0..100, higher freer."""
    return F.lit(100.0) - (rights + liberties - 2.0) / 12.0 * 100.0


def read_fiw_cats(spark: SparkSession, path: str) -> DataFrame:
    columns = ["Country/Territory", "Edition", *[k for k, _m, _l in dims.FREEDOM_CATEGORIES], "Total"]
    return clean_fiw_cats(_csv(spark, path, columns))


def clean_fiw_cats(raw: DataFrame) -> DataFrame:
    """year, country, cat_A .. cat_G as percentages of their maxima, total."""
    pct = lambda k, m: F.bround(F.col(k).try_cast("double") / float(m) * 100.0, 1).alias(f"cat_{k}")
    typed = raw.select(
        (F.col("Edition").try_cast("double").cast("int") - 1).alias("year"), F.trim(F.col("`Country/Territory`")).alias("country"),
        *[pct(k, m) for k, m, _l in dims.FREEDOM_CATEGORIES], F.bround(F.col("Total").try_cast("double"), 1).alias("total"),
    )
    return typed.where(F.col("year").isNotNull() & F.col("country").isNotNull())


# --- polygons --------------------------------------------------------------------------------------


def read_zones(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Features of GeoJSON collections, one collection per file, numbered by file, then place in it.

    Large files are read by many tasks, feature by feature.
    """
    records = json_records(spark, path, lists=1, objects=1)
    return zone_rings(records.select(global_place().alias("ord"), F.from_json("doc", _feature(properties)).alias("_f")), properties)


def _feature(properties: list[str]) -> str:
    fields = ",".join(f"`{p}`:string" for p in properties)
    return f"struct<properties:struct<{fields}>,geometry:struct<type:string,coordinates:string>>"


def geojson_zones(docs: DataFrame, properties: list[str]) -> DataFrame:
    """Features of collections held one per row in ``doc``, numbered by place."""
    features = F.from_json(F.get_json_object("doc", "$.features"), f"array<{_feature(properties)}>")
    return zone_rings(docs.select(F.posexplode(features).alias("ord", "_f")), properties)


def zone_rings(rows: DataFrame, properties: list[str]) -> DataFrame:
    """ord, the wanted properties, rings (all rings of Polygon and MultiPolygon features together)."""
    coordinates = F.col("_f.geometry.coordinates")
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(F.col("_f.geometry.type") == "Polygon", polygon).when(F.col("_f.geometry.type") == "MultiPolygon", multi)
    as_points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select("ord", *[F.col(f"_f.properties.{p}").alias(p) for p in properties], as_points.cast(RINGS_TYPE).alias("rings")).where(
        F.col("rings").isNotNull()
    )
