"""Elevation grids in text: ESRI ASCII, GML coverages and XYZ point lists.

Readers take a DataFrame (id, text), as spark.read.text(..., wholetext=True) gives it, and return cells
(id, row, col, h) with row 0 in the north and null for no data, or one row of metadata per file.  Files are
parsed by JVM expressions; a file that breaks the format's rules yields a null grid, or an error if strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.crs import valid_crs

# fixed value: the no-data number of a grid that names none
ASC_NO_DATA = -9999.0
#: Blanks of a line, without its end: `^\s*` would go over the same empty lines from each of them.
_BLANKS = r"[ \t\x0B\f\r]*"
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def likely_asc(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 2048))
    has = lambda p: head.rlike(rf"(^|\n){_BLANKS}{p}\s+")
    return has("ncols") & has("nrows") & has("xll(corner|center)") & has("yll(corner|center)") & has("cellsize")


def likely_gml(text: Column) -> Column:
    return F.coalesce(text.contains("RectifiedGridCoverage") | text.contains("GridCoverage") | text.contains("tupleList"), F.lit(False))


_ASC_FIELDS = ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "nodata_value")


def asc_meta(files: DataFrame, *more: Column) -> DataFrame:
    """id, cols, rows, west, north, cell, no_data, values: the header of ASCII grids, with `more` columns of files.  A centre counts before a corner
    and is moved to its cell's outer edge; longitudes from 180 to 360 are turned back."""
    # each text is cleaned once and each field looked for once
    t = files.select("id", *more, F.regexp_replace(F.col("text"), rf"(?m)^{_BLANKS}(#|//).*$", "").alias("_text"))
    own = t.columns[1:-1]
    got = t.select("id", *own, "_text", *[F.regexp_extract("_text", rf"(?im)^{_BLANKS}{key}\s+({_NUMBER})", 1).alias(f"_{key}") for key in _ASC_FIELDS])
    field = lambda key: F.when(F.col(f"_{key}") != "", F.col(f"_{key}").cast("double"))
    cell = field("cellsize")
    x = F.coalesce(field("xllcenter") - cell / 2, field("xllcorner"))
    y = F.coalesce(field("yllcenter") - cell / 2, field("yllcorner"))
    rows = field("nrows").cast("int")
    body = F.regexp_replace("_text", rf"(?im)^{_BLANKS}({'|'.join(_ASC_FIELDS)})\s+.*$", "")
    values = F.transform(F.regexp_extract_all(body, F.lit(f"({_NUMBER})"), 1), lambda v: v.cast("double"))
    return got.select("id", field("ncols").cast("int").alias("cols"), rows.alias("rows"), F.when(x > 180, x - 360).otherwise(x).alias("west"), (y + cell * rows).alias("north"), cell.alias("cell"), F.coalesce(field("nodata_value"), F.lit(ASC_NO_DATA)).alias("no_data"), values.alias("values"), *own)


def read_asc(files: DataFrame, strict: bool = True) -> DataFrame:
    """Cells of ASCII grids: the first rows times columns values.  A file with fewer is an error, or left out if not
    strict."""
    m = asc_meta(files)
    whole = F.size("values") >= F.col("rows") * F.col("cols")
    m = m.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("too few cells in "), F.col("id").cast("string"))).cast("boolean"))) if strict else m.where(whole)
    cells = m.select("id", "cols", "no_data", F.posexplode(F.slice("values", F.lit(1), F.col("rows") * F.col("cols"))).alias("i", "v"))
    return cells.select("id", F.floor(F.col("i") / F.col("cols")).cast("int").alias("row"), (F.col("i") % F.col("cols")).alias("col"), F.when(F.col("v") != F.col("no_data"), F.col("v")).alias("h"))


def gml_meta(files: DataFrame) -> DataFrame:
    """id, cols, rows, epsg and values of rectified grid coverages: limits, the last code of a srsName, and the
    tuples' last numbers (null where there is none)."""
    t = F.col("text")
    field = lambda tag: F.regexp_extract(t, rf"<(?:\w+:)?{tag}[^>]*>\s*([^<]*?)\s*</", 1)
    pair = lambda s, i: F.element_at(F.split(s, r"\s+"), i).cast("int")
    lo, hi = field("low"), field("high")
    code = F.regexp_extract(F.regexp_extract(t, r'srsName="([^"]*)"', 1), r"(\d{4,6})(?!.*\d)", 1)
    last = lambda c: F.element_at(F.filter(F.transform(F.split(c, ","), lambda p: F.when(F.trim(p).rlike(f"^{_NUMBER}$"), F.trim(p).cast("double"))), lambda v: v.isNotNull()), -1)
    chunks = F.filter(F.split(F.trim(field("tupleList")), r"\s+"), lambda c: c != "")
    safe = F.transform(chunks, lambda c: F.when(c.rlike(r"\d"), last(c)))
    return files.select("id", (pair(hi, 1) - pair(lo, 1) + 1).alias("cols"), (pair(hi, 2) - pair(lo, 2) + 1).alias("rows"), F.nullif(code, F.lit("")).cast("int").alias("epsg"), safe.alias("values"), field("startPoint").alias("start"))


def read_gml(files: DataFrame) -> DataFrame:
    """Cells of coverages; values begin at the start point, cells before it are holes."""
    m = gml_meta(files)
    pair = lambda i: F.coalesce(F.element_at(F.split("start", r"\s+"), i).try_cast("int"), F.lit(0))
    skip = F.when(F.col("start") == "", 0).otherwise(pair(2) * F.col("cols") + pair(1))
    grid = F.concat(F.array_repeat(F.lit(None).cast("double"), skip.cast("int")), F.col("values"))
    cells = m.where("rows > 0 and cols > 0").select("id", "cols", "rows", F.posexplode(F.slice(grid, 1, F.col("rows") * F.col("cols"))).alias("i", "h"))
    return cells.select("id", F.floor(F.col("i") / F.col("cols")).cast("int").alias("row"), (F.col("i") % F.col("cols")).alias("col"), "h")


def read_xyz(files: DataFrame) -> DataFrame:
    """Cells of point lists (x y z a line): the distinct eastings ascending and northings descending are the
    columns and rows.  Files whose points fill less than 80 or more than 120 percent are left out."""
    p = files.select("id", F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.col("line").rlike(rf"^\s*{_NUMBER}([\s;,]+{_NUMBER}){{2}}"))
    num = lambda i: F.element_at(F.split(F.trim("line"), r"[\s;,]+"), i).cast("double")
    p = p.select("id", num(1).alias("x"), num(2).alias("y"), num(3).alias("z"))
    p = p.groupBy("id", "x", "y").agg(F.max("z").alias("h"))
    per_file = Window.partitionBy("id")
    p = p.withColumn("col", F.dense_rank().over(per_file.orderBy("x")) - 1).withColumn("row", F.dense_rank().over(per_file.orderBy(F.desc("y"))) - 1)
    full = F.count("*").over(per_file) / ((F.max("col").over(per_file) + 1) * (F.max("row").over(per_file) + 1))
    return p.withColumn("full", full).where("full between 0.8 and 1.2").select("id", "row", "col", "h")


def latitude_first(first: Column, second: Column) -> Column:
    """Whether a pair can only be latitude and longitude: the second is beyond what a latitude can be."""
    return F.coalesce((F.abs(first) <= 90) & (F.abs(second) > 90) & (F.abs(second) <= 180), F.lit(False))


def envelope_bounds(text: Column) -> Column:
    """struct(north, south, east, west) of a coverage's envelope, whichever axis comes first; null without two corners."""
    corner = lambda tag: F.transform(F.filter(F.split(F.regexp_extract(text, rf"<(?:\w+:)?{tag}[^>]*>\s*([^<]*?)\s*</", 1), r"[\s,]+"), lambda v: v.rlike(f"^{_NUMBER}$")), lambda v: v.cast("double"))
    lo, hi = corner("lowerCorner"), corner("upperCorner")
    flip = latitude_first(lo[0], lo[1]) | latitude_first(hi[0], hi[1])
    side = lambda pick, i: F.when(flip, pick(lo[i], hi[i])).otherwise(pick(lo[1 - i], hi[1 - i]))
    found = F.struct(side(F.greatest, 0).alias("north"), side(F.least, 0).alias("south"), side(F.greatest, 1).alias("east"), side(F.least, 1).alias("west"))
    return F.when((F.size(lo) >= 2) & (F.size(hi) >= 2), found)


def combined_sources(sources: DataFrame, by: list[str]) -> DataFrame:
    """by, files, north, south, east, west, epsg and unit of parsed files (bounds struct, epsg, unit) that make up one source:
    the outer bounds; a code and a unit count if all files that name one agree."""
    agreed = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    unit = F.when(F.col("unit") != "unknown", F.col("unit"))
    return sources.groupBy(*by).agg(
        F.count("*").alias("files"), F.max("bounds.north").alias("north"), F.min("bounds.south").alias("south"), F.max("bounds.east").alias("east"), F.min("bounds.west").alias("west"),
        agreed(F.col("epsg")).alias("epsg"), F.coalesce(agreed(unit), F.lit("unknown")).alias("unit"),
    )


def placed_in(meta: DataFrame, code: Column) -> DataFrame:
    """ASCII headers (cols, rows, west, north, cell) with the code of a coordinate system that a user chose, the step of a
    column and a row, and the corners; without a positive code, or of an empty grid, these are null."""
    ok = (code > 0) & (F.col("cols") > 0) & (F.col("rows") > 0)
    east, south = F.col("west") + F.col("cell") * F.col("cols"), F.col("north") - F.col("cell") * F.col("rows")
    sides = F.struct(F.col("north"), south.alias("south"), east.alias("east"), F.col("west"))
    return meta.select("*", F.when(code > 0, code).alias("epsg"), F.when(ok, (east - F.col("west")) / F.col("cols")).alias("step_x"), F.when(ok, (south - F.col("north")) / F.col("rows")).alias("step_y"), F.when(ok, sides).alias("bounds"))


def epsg_of_wkt(wkt: Column) -> Column:
    """The last code of a coordinate system named in the horizontal part of a definition in text."""
    flat = F.element_at(F.split(wkt, r",VERT_CS\[|,VERT_DATUM\["), 1)
    codes = F.transform(F.regexp_extract_all(flat, F.lit(r'(?i)(?:AUTHORITY\["EPSG","|\bID\["EPSG",)(\d+)"?\]'), 1), lambda c: c.try_cast("int"))
    return F.try_element_at(F.filter(codes, valid_crs), F.lit(-1))


def epsg_of_keys(keys: Column) -> Column:
    """The code of the first inline projected or geographic key of a directory (array of struct id, location, value), if it
    is one of a coordinate system."""
    own = F.filter(keys, lambda k: k["id"].isin(3072, 2048) & (k["location"] == 0))
    first = F.try_element_at(own, F.lit(1))["value"]
    return F.when(valid_crs(first), first)


def linear_unit(code: Column) -> Column:
    return F.when(code == 9001, "meters").when(code == 9002, "feet").when(code == 9003, "us_survey_feet").otherwise("unknown")


def epsg_of_label(label: Column) -> Column:
    """The code of a Polish zone's label; the national system for any other."""
    text = F.upper(F.coalesce(label, F.lit("")))
    zone = F.regexp_extract(text, r"PL-2000[: ]S([5-8])", 1)
    return F.when(text.contains("PL-1992") | (zone == ""), 2180).otherwise(zone.try_cast("int") + 2171)


def number_returned(xml: Column) -> Column:
    return F.regexp_extract(xml, r'(?i)numberReturned="(\d+)"', 1).try_cast("int")


def survey_years(xml: Column, first: int = 2018, last: int = 2020) -> Column:
    """The distinct years of the index layers a service lists, newest first."""
    years = F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)SkorowidzNMT(\d{4})"), 1), lambda y: y.cast("int"))
    return F.sort_array(F.array_distinct(F.filter(years, lambda y: y.between(first, last))), asc=False)


def zipped(content: Column) -> Column:
    """Whether a file's first bytes are those of a zip archive, an empty or a split one."""
    return F.coalesce(F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506", "504B0708"), F.lit(False))
