"""SQL twins of the shapes in ``placewise.bind``; a query names them like tables."""

import re

ROWCOL = "CAST(({k} * 7919) % 648 // 36 AS INTEGER) AS row, CAST(({k} * 7919) % 648 % 36 AS INTEGER) AS col"
LON = "(CAST(({k} * 7919) % 36000 AS DOUBLE) / 100 - 180)"
LAT = "(CAST(({k} * 104729) % 17000 AS DOUBLE) / 100 - 85)"
ISO3 = "('N' || chr(CAST({k} // 26 + 65 AS INTEGER)) || chr(CAST({k} % 26 + 65 AS INTEGER)))"
MONEY_MEAN = "(CAST(sum(CAST({v} AS DECIMAL(18,2))) AS DOUBLE) / count({v}))"


def rowcol(key):
    return ROWCOL.format(k=key)


def lon(key):
    return LON.format(k=key)


def lat(key):
    return LAT.format(k=key)


def iso3(key):
    return ISO3.format(k=key)


def mean(value):
    return MONEY_MEAN.format(v=value)


BINDINGS = {
    "b_points": f"SELECT c_custkey AS id, {lon('c_custkey')} AS lon, {lat('c_custkey')} AS lat FROM customer",
    "b_line": f"SELECT *, {rowcol('l_partkey')} FROM lineitem",
    "b_temp": "SELECT row, col, avg(l_quantity) * 1.5::DOUBLE - 30::DOUBLE AS value FROM b_line GROUP BY row, col",
    "b_water": f"SELECT row, col, {mean('l_extendedprice')} / 35::DOUBLE AS value FROM b_line GROUP BY row, col",
    "b_pop": f"SELECT row, col, CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS value FROM (SELECT c_acctbal, {rowcol('c_custkey')} FROM customer) GROUP BY row, col",
    "b_elev": f"SELECT row, col, avg(p_size) - 25::DOUBLE AS value FROM (SELECT p_size, {rowcol('p_partkey')} FROM part) GROUP BY row, col",
    "b_gdp": f"SELECT row, col, year, {mean('o_totalprice')} / 6::DOUBLE AS value FROM (SELECT o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year, {rowcol('o_custkey')} FROM orders) GROUP BY row, col, year",
    "b_layers": "SELECT 'temp' AS axis, * FROM b_temp UNION ALL SELECT 'water' AS axis, * FROM b_water UNION ALL SELECT 'pop' AS axis, * FROM b_pop",
    "b_cube": "SELECT row, col, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, min(l_quantity) AS tmin, max(l_quantity) AS tmax, sum(l_quantity) AS ppt FROM b_line GROUP BY ALL",
    "b_crops": "SELECT CAST(l_suppkey % 46 AS INTEGER) AS crop, row, col, sum(l_quantity) AS value FROM b_line GROUP BY ALL",
    "b_hazard": f"SELECT l_linenumber AS hazard, row, col, {mean('l_discount')} AS intensity FROM b_line GROUP BY ALL",
    "b_plants": f"SELECT p_partkey AS id, {lon('p_partkey')} AS lon, {lat('p_partkey')} AS lat, p_retailprice AS capacity, p_type AS fuel, n_name AS country FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25",
    "b_speed": f"SELECT event_id AS id, {lon('event_id')} AS west, {lat('event_id')} AS south, value * 2000::DOUBLE AS kbps FROM events",
    "b_adm1": f"SELECT n_nationkey AS ord, n_name AS name, {iso3('n_nationkey')} AS iso3, 'REG' || n_regionkey AS admin, -180::DOUBLE + n_nationkey % 5 * 72::DOUBLE AS west, 90::DOUBLE - n_nationkey // 5 * 36::DOUBLE AS north, 72::DOUBLE AS w, 36::DOUBLE AS h FROM nation",
    "b_adm0": "SELECT r_regionkey AS ord, 'REGION_' || r_regionkey AS name, 'R0' || r_regionkey AS iso3, -180::DOUBLE + r_regionkey * 72::DOUBLE AS west, 90::DOUBLE AS north, 72::DOUBLE AS w, 180::DOUBLE AS h FROM region",
    "b_cells": "SELECT CAST(r.v AS INTEGER) AS row, CAST(c.v AS INTEGER) AS col, -180::DOUBLE + (c.v + 0.5::DOUBLE) * 10::DOUBLE AS xc, 90::DOUBLE - (r.v + 0.5::DOUBLE) * 10::DOUBLE AS yc FROM range(18) r(v), range(36) c(v)",
    "b_cell_adm1": "SELECT row, col, ord AS zone FROM b_cells JOIN b_adm1 ON xc >= west AND xc < west + w AND yc <= north AND yc > north - h",
    "b_cell_adm0": "SELECT row, col, ord AS zone FROM b_cells JOIN b_adm0 ON xc >= west AND xc < west + w AND yc <= north AND yc > north - h",
    "b_tri": f"SELECT s_suppkey AS ord, {lon('s_suppkey')} AS a, {lat('s_suppkey')} AS b FROM supplier",
    "b_tri_edge": "SELECT ord, a AS x1, b AS y1, a + 33.5::DOUBLE AS x2, b - 21.25::DOUBLE AS y2 FROM b_tri UNION ALL SELECT ord, a + 33.5::DOUBLE, b - 21.25::DOUBLE, a - 17.75::DOUBLE, b - 40.5::DOUBLE FROM b_tri UNION ALL SELECT ord, a - 17.75::DOUBLE, b - 40.5::DOUBLE, a, b FROM b_tri",
    "b_tri_cell": "SELECT ord, row, col FROM b_cells JOIN b_tri_edge ON ((y1 <= yc) <> (y2 <= yc)) AND x1 + (yc - y1) * (x2 - x1) / (y2 - y1) <= xc GROUP BY ord, row, col HAVING count(*) % 2 = 1",
    "b_indicator": f"SELECT n_name AS name, {iso3('n_nationkey')} AS iso3, n_nationkey, CAST(year(o_orderdate) AS INTEGER) AS year, {mean('o_totalprice')} AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "b_brush": "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'erase' ELSE 'paint' END AS op, 8 AS level, CAST(user_id * 37 % 256 AS INTEGER) AS cx, CAST(event_id * 101 % 256 AS INTEGER) AS cy, CAST(event_id % 4 AS INTEGER) AS r FROM events",
    "b_quad": "SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'erase' ELSE 'paint' END AS op, CAST(3 + event_id % 5 AS INTEGER) AS level, CAST(user_id * 37 % (1 << CAST(3 + event_id % 5 AS INTEGER)) AS INTEGER) AS cx, CAST(event_id * 101 % (1 << CAST(3 + event_id % 5 AS INTEGER)) AS INTEGER) AS cy FROM events",
    "b_art": "SELECT s || '/' || s || CASE s WHEN 'f' THEN '_ssp585_' || y WHEN 'o' THEN '_' || y ELSE '' END || '.pmtiles' AS path FROM (SELECT lower(o_orderstatus) AS s, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)",
}


def with_bindings(sql: str) -> str:
    """Prefix ``sql`` with the bindings it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bb_[a-z0-9_]+\b", text):
            if name in BINDINGS and name not in needed:
                visit(BINDINGS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{name} AS ({BINDINGS[name]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
