"""Records from map services and binary files: encoded polylines, map elements in JSON, link lists in XML,
point clouds, zipped grids and mesh containers."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT_SCHEMA = "elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>>>"


def encoded_number(n: Column) -> Column:
    """A whole number of 1e-5 degrees as the polyline format writes it: sign in the lowest bit, then groups of five bits
    from the lowest on, 32 more for all but the last, 63 beyond that in ASCII."""
    v = F.when(n < 0, -2 * n - 1).otherwise(2 * n).cast("long")
    group = lambda i: F.shiftright(v, 5 * i)
    char = lambda g: F.char(g % 32 + F.when(g >= 32, 32).otherwise(0) + 63)
    return F.concat(char(v), *[F.when(group(i) > 0, char(group(i))).otherwise("") for i in range(1, 7)])


def decode_polyline(text: Column) -> Column:
    """array<struct<lat, lng>> of an encoded polyline: five-bit groups, low first, signs in the lowest bit,
    differences in units of 1e-5.  An unfinished number, or one without its partner, at the end is left out."""
    return F.arrow_udf(_decoded, "array<struct<lat:double,lng:double>>")(text)


def _decoded(texts: pa.Array) -> pa.Array:
    """All texts of a batch at a time: their characters in one array, numbers by reduceat, places by running sums less their text's start."""
    own = [(t or "").encode("utf-32-le") for t in texts.to_pylist()]
    sizes = np.array([len(t) // 4 for t in own], np.int64)
    codes = np.frombuffer(b"".join(own), np.uint32).astype(np.int64) - 63
    starts = np.zeros(len(own) + 1, np.int64)
    of_text, more = np.repeat(np.arange(len(own)), sizes), codes >= 32
    head = np.ones(len(codes), bool)
    head[1:] = ~more[:-1] | (of_text[1:] != of_text[:-1])
    first = np.flatnonzero(head)
    lat = lng = np.zeros(0, np.int64)
    if len(codes):
        last = np.append(first[1:], len(codes)) - 1
        digit = np.arange(len(codes)) - np.repeat(first, last - first + 1)
        value = np.add.reduceat(np.fmod(codes, 32) << (5 * digit), first)[~more[last]]
        value, by = np.where(value % 2 == 1, -((value + 1) // 2), value // 2), of_text[first][~more[last]]
        count = np.bincount(by, minlength=len(own))
        nth = np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)
        paired = nth < (count // 2 * 2)[by]
        starts[1:] = np.cumsum(count // 2)
        run = lambda v: (lambda s: s[1:] - np.repeat(s[starts[:-1]], np.diff(starts)))(np.append(0, np.cumsum(v)))
        lat, lng = run(value[paired & (nth % 2 == 0)]), run(value[paired & (nth % 2 == 1)])
    places = pa.StructArray.from_arrays([pa.array(lat / 1e5), pa.array(lng / 1e5)], names=["lat", "lng"])
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), places)


def read_elements(files: DataFrame) -> DataFrame:
    """Map elements of JSON answers (id, text): file, ord, type, id, lat, lng, tags, geometry, members."""
    e = files.select(F.col("id").alias("file"), F.posexplode(F.from_json("text", ELEMENT_SCHEMA)["elements"]).alias("ord", "e"))
    points = F.transform("e.geometry", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lng")))
    return e.select("file", "ord", "e.type", "e.id", "e.lat", F.col("e.lon").alias("lng"), "e.tags", points.alias("geometry"), "e.members")


def links_in_xml(files: DataFrame) -> DataFrame:
    """id, key, url of the first link of each key in a feature list: http(s) only, the key is the sheet's code or
    else the address."""
    blocks = files.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<wfs:member>(.*?)</wfs:member>"), 1)).alias("n", "b"))
    field = lambda tag: F.nullif(F.regexp_extract("b", rf"<(?:\w+:)?{tag}>\s*([^<]*?)\s*</", 1), F.lit(""))
    rows = blocks.select("id", "n", field("url_do_pobrania").alias("url"), field("godlo").alias("sheet")).where(F.col("url").rlike("^https?://"))
    rows = rows.withColumn("key", F.coalesce("sheet", "url"))
    return rows.groupBy("id", "key").agg(F.min_by("url", "n").alias("url"))


def unzipped(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """id, name, text of the entries of zip files (id, content) with one of the suffixes.  One archive is
    opened at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, content in zip(batch["id"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(suffixes)]
                    for n in names:
                        yield pd.DataFrame({"id": [i], "name": [n], "text": [z.read(n).decode("utf-8", "replace")]})

    return files.select("id", "content").mapInPandas(run, f"id {dict(files.dtypes)['id']}, name string, text string")


def las_header(content: bytes) -> dict:
    """The public header of a LAS file: version, point format and size, number, scales, offsets, start."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, header = content[25], struct.unpack_from("<H", content, 94)[0]
    start = struct.unpack_from("<I", content, 96)[0]
    kind, size, count = struct.unpack_from("<BHI", content, 104)
    if minor >= 4 and header >= 375:
        count = struct.unpack_from("<Q", content, 247)[0] or count
    return {"minor": minor, "format": kind & 0x3F, "size": size, "count": count, "start": start, "scale": struct.unpack_from("<3d", content, 131), "offset": struct.unpack_from("<3d", content, 155)}


def read_las(files: DataFrame) -> DataFrame:
    """id, x, y, z, class of the points of uncompressed LAS files (id, content), some at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, content in zip(batch["id"], batch["content"]):
                h = las_header(content)
                at_class = 16 if h["format"] >= 6 else 15
                raw = np.frombuffer(content, np.uint8, h["count"] * h["size"], h["start"]).reshape(-1, h["size"])
                for n in range(0, len(raw), 200_000):
                    part = raw[n : n + 200_000]
                    xyz = part[:, :12].copy().view("<i4").astype(float) * h["scale"] + h["offset"]
                    yield pd.DataFrame({"id": i, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "class": (part[:, at_class] & 0x1F).astype(np.int32)})

    return files.select("id", "content").mapInPandas(run, f"id {dict(files.dtypes)['id']}, x double, y double, z double, class int")


def read_container(content: bytes) -> tuple[dict, bytes]:
    """The JSON header and payload of a mesh container: magic MBK1, header length, header padded to 4 bytes."""
    magic, size = content[:4], struct.unpack_from("<I", content, 4)[0]
    if magic != b"MBK1":
        raise ValueError("not a mesh container")
    return json.loads(content[8 : 8 + size]), content[8 + size + -(8 + size) % 4 :]


def read_places(files: DataFrame) -> DataFrame:
    """id, n, lat, lng, name, label, kind of the places in a search answer; those without a position are left out."""
    schema = "array<struct<lat:string,lon:string,name:string,display_name:string,type:string,address:map<string,string>>>"
    p = files.select("id", F.posexplode(F.from_json("text", schema)).alias("n", "p"))
    p = p.select("id", "n", F.col("p.lat").try_cast("double").alias("lat"), F.col("p.lon").try_cast("double").alias("lng"), F.coalesce(F.nullif("p.name", F.lit("")), F.split("p.display_name", ",")[0]).alias("name"), F.col("p.display_name").alias("label"), F.col("p.type").alias("kind"))
    return p.where("lat is not null and lng is not null")


def address_name(address: Column, name: Column, label: Column, keys: tuple[str, ...] = ("road", "hamlet", "village", "town", "suburb", "city", "county", "state", "country")) -> Column:
    """The first address part that is given, else the name, else the label."""
    return F.coalesce(*[F.nullif(address[k], F.lit("")) for k in keys], F.nullif(name, F.lit("")), label)


def year_order(preferred: int, first: int = 2018, last: int = 2020) -> list[int]:
    """Years to try: from the preferred one down, then up."""
    return [y for y in (*range(min(preferred, last), first - 1, -1), *range(preferred + 1, last + 1)) if first <= y <= last]


def newest_sheets(index: DataFrame, years: list[int]) -> DataFrame:
    """index rows (sheet, year, url) of the year that comes first in `years` for each sheet."""
    rank = F.array_position(F.array(*map(F.lit, years)), F.col("year"))
    return index.where(F.col("year").isin(*years)).groupBy("sheet").agg(F.min_by(F.struct("year", "url"), F.struct(rank, "url")).alias("b")).select("sheet", "b.*")
