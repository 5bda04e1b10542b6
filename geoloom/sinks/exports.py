"""Sinks: ASCII and terrain binary grids, GeoJSON, JSON lines, reports and archives of entries."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asc_text(cells: DataFrame, west: float, south: float, cell: float) -> DataFrame:
    """id, text of grids (id, row, col, h) in ESRI ASCII form."""
    lines = cells.groupBy("id", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", F.coalesce("h", F.lit(-9999.0)).alias("h")))), lambda c: c["h"].cast("string")), " ").alias("line"), F.count("*").alias("cols"))
    body = lines.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("body"), F.max("cols").alias("cols"), F.count("*").alias("rows"))
    return body.select("id", F.format_string(f"ncols %d\nnrows %d\nxllcorner {west!r}\nyllcorner {south!r}\ncellsize {cell!r}\nNODATA_value -9999\n%s\n", "cols", "rows", "body").alias("text"))


def feature_json(kind: Column, tags: Column, geometry: Column, fid: Column) -> Column:
    """A GeoJSON feature: a polygon if it is a building or closed vegetation, else a line."""
    points = F.transform(geometry, lambda p: F.array(p["lng"], p["lat"]))
    closed = (F.size(geometry) > 3) & (F.element_at(geometry, 1) == F.element_at(geometry, -1))
    area = (kind == "building") | ((kind == "vegetation") & closed)
    props = F.struct(fid.alias("id"), kind.alias("feature_type"), tags.alias("tags"))
    feature = lambda shape, coords: F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit(shape).alias("type"), coords.alias("coordinates")).alias("geometry")))
    return F.when(area, feature("Polygon", F.array(points))).otherwise(feature("LineString", points))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def terrain_binary(cells: pd.DataFrame, size: int, materials: list[str], layers: np.ndarray | None = None) -> bytes:
    """A terrain file of version 9: size, 16-bit heights from the south, layer bytes, material names."""
    h = np.zeros((size, size))
    h[cells["row"], cells["col"]] = cells["h"].fillna(0)
    lo, hi = h.min(), h.max()
    q = np.floor((h - lo) / (hi - lo) * 65535).clip(0, 65535) if hi > lo else np.zeros_like(h)
    names = b"".join(struct.pack("<B", len(m.encode())) + m.encode() for m in materials)
    layer = np.zeros((size, size), np.uint8) if layers is None else layers
    return struct.pack("<BI", 9, size) + q[::-1].astype("<u2").tobytes() + layer.tobytes() + struct.pack("<I", len(materials)) + names


def terrain_files(cells: DataFrame, size: int, materials: list[str]) -> DataFrame:
    """id, content of terrain files, one a grid (id, row, col, h)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "content": [terrain_binary(pdf, size, materials)]})

    return cells.groupBy("id").applyInPandas(run, f"id {dict(cells.dtypes)['id']}, content binary")


def archives(entries: DataFrame) -> DataFrame:
    """id, content of zip archives of entries (id, ord, path, content), in order; of a repeated path the last."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last = pdf.sort_values("ord").drop_duplicates("path", keep="last")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in zip(last["path"], last["content"]):
                z.writestr(zipfile.ZipInfo(path), bytes(content))
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "content": [out.getvalue()]})

    return entries.groupBy("id").applyInPandas(run, f"id {dict(entries.dtypes)['id']}, content binary")


def deduplicated_names(rows: DataFrame) -> DataFrame:
    """rows (idx, name) with `folder`: a name that came before gets _2, _3, ..."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("name").orderBy("idx"))
    return rows.withColumn("folder", F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), n.cast("string"))))


def container(header: dict, payload: bytes) -> bytes:
    head = json.dumps(header).encode()
    return b"MBK1" + struct.pack("<I", len(head)) + head + b"\0" * (-(8 + len(head)) % 4) + payload
