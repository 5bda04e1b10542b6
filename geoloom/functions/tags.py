"""Rules over map tags (map<string, string> columns): kinds, areas, layers, lanes, widths, materials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import count_delimited, let, parse_float, parse_int, parse_positive_int, parse_width_m

# fixed values: word lists and widths that results must share
AREA_KEYS = ("building", "landuse", "landcover", "water", "leisure", "golf", "recreation", "natural", "amenity", "aeroway", "tourism", "man_made", "public_transport", "power", "military", "place", "historic", "wetland", "surface", "material")
LANDUSE_KEYS = ("landuse", "leisure", "natural", "amenity", "aeroway", "tourism", "man_made", "public_transport", "power", "military", "place", "historic", "wetland", "surface", "material", "golf", "recreation")
AREA_WATERWAYS = ("riverbank", "dock", "boatyard", "dam")
OLD_BUILDINGS = ("castle", "fort", "monastery", "tower", "ruins")
UNMARKED = ("gravel", "dirt", "earth", "ground", "grass", "sand", "mud", "unpaved", "compacted", "fine_gravel", "pebblestone", "rock", "snow", "ice")
UNPAVED = ("dirt", "earth", "gravel", "fine_gravel", "ground", "mud", "sand", "rock", "scree", "grass", "compacted", "unpaved", "pebblestone", "snow", "ice")
NO_ROADS = ("footway", "path", "pedestrian", "steps", "cycleway", "bridleway", "corridor", "proposed", "construction")
MAJOR = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link")
LINKS = ("motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
NO_DECAL_SERVICES = ("parking_aisle", "driveway", "alley", "emergency_access")
FAST, MAIN, MINOR = ("motorway", "motorway_link", "trunk", "trunk_link"), ("primary", "primary_link", "secondary", "secondary_link"), ("tertiary", "tertiary_link")
GROUND_COVER_KEYS = ("surface", "material", "landcover", "landuse", "natural", "water", "wetland", "waterway", "aeroway")
BOUNDARIES = ("administrative", "protected_area", "national_park", "political", "historic")
BARRIER_ASSETS = ((("guard_rail", "guardrail", "handrail"), "guardrail"), (("jersey_barrier", "concrete_barrier"), "concrete"), (("fence", "chain", "wall", "city_wall", "retaining_wall", "block", "cable_barrier", "wire_fence", "gate"), "fence"))
MASK_SKIP = ("footway", "path", "pedestrian", "steps", "cycleway", "bridleway", "corridor")
MASK_ROADS = (("motorway", 12.0), ("trunk", 10.0), ("primary", 8.0), ("secondary", 6.0), ("tertiary", 5.0), ("residential", 4.0), ("unclassified", 4.0), ("living_street", 4.0), ("service", 3.0))
MASK_DEFAULT_M, LEVEL_M = 4.0, 3.0
WATERWAYS = (("river", 26.0, 8.0), ("canal", 14.0, 5.0), ("stream", 8.0, 3.0), ("drain", 4.0, 2.0), ("ditch", 3.0, 1.5))
RETRY_STATUS = (408, 425, 429, 500, 502, 503, 504)
# fixed values: area rules as key, values, material, in order of precedence; -1 is unpainted
AREA_MATERIALS = (
    ("natural", ("grass", "meadow", "heath", "grassland", "shrub", "wood", "scrub", "shrubbery"), 1),
    ("natural", ("sand", "beach", "dune"), 3),
    ("natural", ("bare_rock", "rock", "scree", "cliff", "shingle"), 4),
    ("natural", ("mud",), 2),
    ("natural", ("water", "wetland"), -1),
    ("landuse", ("grass", "meadow", "village_green", "recreation_ground", "allotments", "cemetery", "orchard", "vineyard", "forest", "wood", "religious", "greenfield"), 1),
    ("landuse", ("farmland", "farmyard", "greenhouse_horticulture", "brownfield", "construction", "landfill", "military"), 2),
    ("landuse", ("commercial", "industrial", "retail"), 7),
    ("landuse", ("garages",), 5),
    ("landuse", ("residential",), 1),
    ("landuse", ("quarry",), 4),
    ("landuse", ("railway",), 6),
    ("landuse", ("reservoir", "basin"), -1),
    ("leisure", ("park", "garden", "playground", "recreation_ground", "pitch", "golf_course", "nature_reserve", "common", "dog_park"), 1),
    ("leisure", ("sports_centre", "stadium"), 7),
    ("leisure", ("beach_resort",), 3),
    ("leisure", ("track",), 5),
    ("amenity", ("parking",), 7),
    ("amenity", ("fuel",), 5),
    ("surface", ("asphalt", "paved"), 5),
    ("surface", ("concrete",), 7),
    ("surface", ("gravel", "dirt", "unpaved", "compacted"), 6),
    ("surface", ("grass",), 1),
    ("surface", ("sand",), 3),
)
# fixed values: highway class, material, half width in metres on the layer map
LAYER_ROADS = (("motorway", 5, 9.0), ("motorway_link", 5, 5.0), ("trunk", 5, 8.0), ("trunk_link", 5, 5.0), ("primary", 5, 7.0), ("primary_link", 5, 4.0), ("secondary", 5, 6.0), ("secondary_link", 5, 3.5), ("tertiary", 5, 5.0), ("tertiary_link", 5, 3.0), ("residential", 5, 4.0), ("living_street", 5, 3.0), ("unclassified", 5, 4.0), ("road", 5, 4.0), ("service", 5, 2.5), ("raceway", 5, 6.0), ("busway", 5, 4.0), ("pedestrian", 7, 4.0), ("track", 6, 2.5), ("footway", 7, 1.2), ("cycleway", 7, 1.2), ("path", 6, 1.0))


def _has(tags: Column, key: str) -> Column:
    """Present and not empty."""
    return F.coalesce(tags[key] != "", F.lit(False))


def _is(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tags[key].isin(*values), F.lit(False))


def _any(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _low(tags: Column, key: str) -> Column:
    return F.lower(F.trim(F.coalesce(tags[key], F.lit(""))))


def closed_ring(ring: Column, eps: float = 1e-9) -> Column:
    a, b = F.element_at(ring, 1), F.element_at(ring, -1)
    return (F.size(ring) >= 4) & (F.abs(a["lat"] - b["lat"]) < eps) & (F.abs(a["lng"] - b["lng"]) < eps)


def area_like(tags: Column, ring: Column) -> Column:
    way = F.when(_any(*[_has(tags, k) for k in ("highway", "railway", "barrier")]), False).when(_has(tags, "waterway"), _is(tags, "waterway", *AREA_WATERWAYS)).otherwise(_any(*[_has(tags, k) for k in AREA_KEYS]))
    return F.when(tags.isNull() | (F.size(ring) < 3), False).when(_is(tags, "area", "yes"), True).when(_is(tags, "area", "no"), False).when(~closed_ring(ring), False).otherwise(way)


def feature_kind(tags: Column) -> Column:
    """bridge_infra, building, coastline, water, barrier, landuse or null, the first that fits."""
    water = _any(_is(tags, "natural", "water"), _has(tags, "waterway"), _is(tags, "landuse", "reservoir", "basin"), _is(tags, "leisure", "marina"), _is(tags, "water", "harbour", "dock"), _is(tags, "harbour", "yes"))
    return (
        F.when(_is(tags, "man_made", "bridge") & ~_has(tags, "highway"), "bridge_infra")
        .when(_has(tags, "building") | _is(tags, "historic", *OLD_BUILDINGS), "building")
        .when(_is(tags, "natural", "coastline"), "coastline")
        .when(water, "water")
        .when(_has(tags, "barrier"), "barrier")
        .when(_any(*[_has(tags, k) for k in LANDUSE_KEYS]), "landuse")
    )


def road_layer(tags: Column) -> Column:
    """Stacking order of a road: its layer tag, else what bridges and tunnels imply."""
    given = parse_int(tags["layer"])
    bridge = _any(_is(tags, "bridge", "yes", "viaduct"), _is(tags, "man_made", "bridge"), _is(tags, "location", "overground", "elevated"))
    tunnel = _any(_is(tags, "tunnel", "yes"), _is(tags, "covered", "yes"), _is(tags, "location", "underground", "underwater"))
    implied = bridge.cast("int") - (tunnel | _is(tags, "cutting", "yes")).cast("int")
    wall = _is(tags, "barrier", "retaining_wall") & ~bridge & ~tunnel
    return F.coalesce(given, implied) + F.when(wall, 0.5).otherwise(0.0) + F.when(_is(tags, "embankment", "yes"), 0.5).otherwise(0.0)


def unmarked_surface(tags: Column) -> Column:
    return F.when(_is(tags, "lane_markings", "no"), True).when(_is(tags, "lane_markings", "yes"), False).otherwise(_is(tags, "surface", *UNMARKED) | _is(tags, "highway", "track"))


def likely_unmarked(tags: Column) -> Column:
    mark = _low(tags, "lane_markings")
    return F.when(mark == "yes", False).when(mark == "no", True).otherwise(_low(tags, "surface").isin(*UNPAVED))


def uses_lane_markings(tags: Column) -> Column:
    return _is(tags, "highway", *MAJOR) & ~likely_unmarked(tags)


def uses_grass_edge(tags: Column) -> Column:
    return _is(tags, "highway", *MAJOR) & ~_low(tags, "surface").isin(*UNPAVED)


def makes_decal_road(tags: Column) -> Column:
    return _has(tags, "highway") & ~_any(_is(tags, "highway", *NO_ROADS, "trunk_link", "service"), _is(tags, "area", "yes"), _low(tags, "service").isin(*NO_DECAL_SERVICES))


def one_way(tags: Column) -> Column:
    """By the rule of level roads: reverse counts, roundabouts and motorways imply it."""
    return _any(_low(tags, "oneway").isin("yes", "1", "true", "-1", "reverse"), _is(tags, "junction", "roundabout"), _is(tags, "highway", "motorway", "motorway_link"))


def _by_class(tags: Column, table, other) -> Column:
    out = F.lit(other) if not isinstance(other, Column) else other
    for names, value in reversed(table):
        out = F.when(_is(tags, "highway", *names), F.lit(value) if not isinstance(value, Column) else value).otherwise(out)
    return out


def painter_lane_width(tags: Column) -> Column:
    return _by_class(tags, ((FAST, 3.7), (MAIN, 3.5), (MINOR, 3.25), (("service",), 2.8)), 3.0)


def road_lane_width(tags: Column) -> Column:
    return _by_class(tags, ((FAST, 3.7), (MAIN, 3.5), (MINOR, 3.25), (("service", "track"), 2.8)), 3.0)


def most_lanes(tags: Column, oneway: Column) -> Column:
    pick = lambda a, b: F.when(oneway, a).otherwise(b)
    return _by_class(tags, ((("motorway", "trunk"), pick(6, 10)), (LINKS, pick(3, 4)), (("primary", "secondary"), pick(5, 8))), pick(4, 6))


def default_lanes(tags: Column, oneway: Column) -> Column:
    pick = lambda a, b: F.when(oneway, a).otherwise(b)
    return _by_class(tags, ((("motorway", "trunk"), pick(2, 4)), (LINKS, F.lit(1)), (("service", "track"), F.lit(1))), pick(1, 2))


def lane_counts(tags: Column, oneway: Column) -> Column:
    """struct(total, forward, backward) from the lane tags, the turn lanes or the class."""
    given = F.struct(
        parse_positive_int(tags["lanes"]).alias("total"),
        F.coalesce(parse_positive_int(tags["lanes:forward"]), count_delimited(tags["turn:lanes:forward"])).alias("fwd"),
        F.coalesce(parse_positive_int(tags["lanes:backward"]), count_delimited(tags["turn:lanes:backward"])).alias("back"),
        count_delimited(tags["turn:lanes"]).alias("turn"),
        most_lanes(tags, oneway).alias("most"),
        _is(tags, "highway", "motorway", "trunk").alias("fast"),
        _is(tags, "highway", *LINKS, "service", "track").alias("narrow"),
        oneway.alias("oneway"),
    )
    at_least_one = lambda x: F.greatest(F.lit(1), x)

    def sides(g: Column) -> Column:
        """Each side: as tagged, else the rest of a tagged total, else half of the guess."""
        guess = F.coalesce(g["total"], F.when(g["fast"], 4).when(g["narrow"], 1).otherwise(2))
        half, neither = F.ceil(guess / 2), g["fwd"].isNull() & g["back"].isNull()
        one = at_least_one(F.least(g["most"], F.coalesce(g["fwd"], g["total"], g["turn"], F.when(g["fast"], 2).otherwise(1))))
        f = F.when(neither, half).otherwise(F.coalesce(g["fwd"], at_least_one(g["total"] - g["back"]), F.lit(1)))
        b = F.when(neither, at_least_one(guess - half)).otherwise(F.coalesce(g["back"], at_least_one(g["total"] - g["fwd"]), F.lit(1)))
        return F.struct(F.when(g["oneway"], one).otherwise(f).alias("f"), F.when(g["oneway"], 0).otherwise(b).alias("b"), g["most"].alias("most"), g["oneway"].alias("oneway"))

    def capped(s: Column) -> Column:
        over = ~s["oneway"] & (s["f"] + s["b"] > s["most"])
        return F.struct(F.when(over, at_least_one(F.floor(s["f"] * (s["most"] / (s["f"] + s["b"])) + 0.5))).otherwise(s["f"]).alias("f"), s["b"].alias("b"), s["most"].alias("most"), s["oneway"].alias("oneway"), over.alias("over"))

    def result(s: Column) -> Column:
        back = F.when(s["over"], at_least_one(s["most"] - s["f"])).otherwise(s["b"])
        total = F.when(s["oneway"], s["f"]).otherwise(F.greatest(F.lit(2), s["f"] + back))
        return F.struct(total.cast("bigint").alias("total"), s["f"].cast("bigint").alias("forward"), back.cast("bigint").alias("backward"))

    return let(let(let(given, sides), capped), result)


def centre_line(tags: Column, lanes: Column, oneway: Column) -> Column:
    """white solid, yellow double, yellow dashed or null."""
    return (
        F.when(oneway | F.coalesce(tags["highway"].endswith("_link"), F.lit(False)), F.lit(None).cast("string"))
        .when(_is(tags, "highway", "motorway", "trunk"), "white solid")
        .when(_is(tags, "highway", "primary", "secondary"), F.when(lanes >= 4, "yellow double").otherwise("yellow dashed"))
        .when(_is(tags, "highway", "tertiary"), "yellow dashed")
        .when(_is(tags, "highway", "residential", "unclassified") & (lanes >= 4), "yellow dashed")
    )


def edge_line_width(tags: Column) -> Column:
    return F.when(_is(tags, "highway", *FAST), 0.15).when(_is(tags, "highway", "primary", "secondary"), 0.1)


def skips_lane_detail(tags: Column, lanes: Column) -> Column:
    return _any(_is(tags, "highway", *LINKS), road_layer(tags) != 0, *[_is(tags, k, "yes") for k in ("bridge", "tunnel", "covered")], lanes >= 6)


def half_width(tags: Column, oneway: Column) -> Column:
    """Metres: half the width tag, else lanes by class, within the class's limits."""
    lo = _by_class(tags, ((FAST, 3.5), (MAIN, 2.8), (("service", "track"), 1.8)), 2.2)
    hi = _by_class(tags, ((FAST, 9.0), (MAIN, 6.0), (("service", "track"), 3.5)), 5.0)
    zero = lambda k: F.coalesce(parse_positive_int(tags[k]), F.lit(0))
    tagged = F.when(zero("lanes") > 0, zero("lanes")).otherwise(zero("lanes:forward") + zero("lanes:backward"))
    lanes = F.greatest(default_lanes(tags, oneway), tagged)
    return F.greatest(lo, F.least(hi, F.coalesce(parse_width_m(tags["width"]) / 2, lanes * road_lane_width(tags) / 2)))


def area_material(tags: Column) -> Column:
    out = F.lit(-1)
    for key, values, mat in reversed(AREA_MATERIALS):
        out = F.when(_is(tags, key, *values), mat).otherwise(out)
    return out


def layer_road(tags: Column) -> Column:
    """struct(mat, half_m) of a highway class on the layer map, or null."""
    out = F.lit(None).cast("struct<mat:int,half_m:double>")
    for name, mat, half in LAYER_ROADS:
        out = F.when(_is(tags, "highway", name), F.struct(F.lit(mat).alias("mat"), F.lit(half).alias("half_m"))).otherwise(out)
    return out


def colour_material(r: Column, g: Column, b: Column) -> Column:
    """Ground material 0-7 by hue, saturation and value; classes in order of precedence."""
    hi, lo = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    d = hi - lo
    s = F.when(hi == 0, 0.0).otherwise(d / hi)
    rn, gn, bn = r / 255.0, g / 255.0, b / 255.0
    h = F.when(d <= 0, 0.0).when(hi == rn, (gn - bn) / d * 60).when(hi == gn, ((bn - rn) / d + 2) * 60).otherwise(((rn - gn) / d + 4) * 60)
    h = F.when(h < 0, h + 360).otherwise(h)
    return (
        F.when(hi < 0.25, 5)
        .when(h.between(170, 265) & (s > 0.25), 0)
        .when(h.between(60, 160) & (s > 0.12), 1)
        .when((h >= 40) & (h < 60) & (s > 0.1) & (hi > 0.35), 1)
        .when((h >= 30) & (h < 60) & (s > 0.15) & (hi > 0.55), 3)
        .when((h >= 15) & (h < 45) & (s > 0.15), 2)
        .when(((h < 20) | (h > 340)) & (s > 0.2), 7)
        .when(s < 0.1, F.when(hi < 0.4, 4).when(hi < 0.72, 7).otherwise(1))
        .otherwise(1)
    )


def flat_ground(tags: Column) -> Column:
    return ~_has(tags, "building") & _any(_is(tags, "amenity", "parking"), _is(tags, "place", "square"), _has(tags, "area:highway"), _is(tags, "area", "yes") & _is(tags, "highway", "pedestrian", "footway", "service", "living_street"))


# fixed values: half widths in metres of roads that lie on the ground, by class, that of all others, and classes that aren't driven on
GROUND_HALF = {"motorway": 12.0, "trunk": 10.0, "primary": 8.0, "secondary": 6.0, "tertiary": 5.0, "residential": 4.0, "unclassified": 4.0, "living_street": 4.0, "service": 3.0}
GROUND_HALF_ELSE = 4.0
NOT_DRIVEN = ("footway", "path", "pedestrian", "steps", "cycleway", "bridleway", "corridor")


def on_ground(tags: Column) -> Column:
    """No bridge, no tunnel, and no layer but 0; a layer that is no number counts as one."""
    off = lambda k: _has(tags, k) & (tags[k] != "no")
    layer = F.trim(tags["layer"])
    level = tags["layer"].isNull() | (layer == "") | F.coalesce(layer.try_cast("double") == 0, F.lit(False))
    return ~off("bridge") & ~off("tunnel") & level


def ground_half(tags: Column) -> Column:
    """Half the width in metres of a road on the ground, null for ways that aren't driven on."""
    out = F.lit(GROUND_HALF_ELSE)
    for name, half in GROUND_HALF.items():
        out = F.when(_is(tags, "highway", name), half).otherwise(out)
    return F.when(~_is(tags, "highway", *NOT_DRIVEN), out)


def excluded_water(tags: Column) -> Column:
    """Sea and harbour water, which is no inland water."""
    return _any(_is(tags, "place", "sea", "ocean"), _is(tags, "natural", "bay"), _is(tags, "water", "dock", "harbour"), _is(tags, "harbour", "yes"), _is(tags, "leisure", "marina"))


def ground_cover(tags: Column) -> Column:
    return _any(*[_has(tags, k) for k in GROUND_COVER_KEYS])


def boundary_only(tags: Column) -> Column:
    """A border without a ground of its own."""
    return F.lower(F.coalesce(tags["boundary"], F.lit(""))).isin(*BOUNDARIES) & ~ground_cover(tags)


def barrier_asset(tags: Column) -> Column:
    """The kind of prefabricated barrier, null for none and for hedges."""
    kind = _low(tags, "barrier")
    out = F.when(kind.isin("", "hedge"), F.lit(None).cast("string"))
    for names, asset in BARRIER_ASSETS:
        out = out.when(kind.isin(*names), asset)
    return out.when((kind == "chain_link") | (_low(tags, "material") == "chain_link"), "chain_link").otherwise("guardrail")


def barrier_size(tags: Column) -> Column:
    """struct(height_m, width_m) of a barrier's body."""
    size = lambda h, w: F.struct(F.lit(h).alias("height_m"), F.lit(w).alias("width_m"))
    return F.when(_is(tags, "barrier", "city_wall"), size(4.0, 0.5)).when(_is(tags, "barrier", "wall", "retaining_wall"), size(2.0, 0.5)).when(_is(tags, "barrier", "fence", "gate"), size(1.5, 0.1)).when(_is(tags, "barrier", "hedge"), size(1.2, 0.8)).otherwise(size(1.5, 0.2))


def building_size(tags: Column, area_m2: Column, seed: Column) -> Column:
    """struct(levels, height, min_height, roof, roof_height) in metres and levels; a church's height, free between
    20 and 30, follows from the seed."""
    first = lambda *keys: F.coalesce(*[F.nullif(tags[k], F.lit("")) for k in keys])
    number = lambda *keys: F.coalesce(parse_float(first(*keys)), F.lit(0.0))
    kind = F.coalesce(first("building", "building:part"), F.lit("yes"))
    given, roof_levels, roof_given, low = number("building:levels", "levels"), number("roof:levels", "building:roof:levels"), number("roof:height", "building:roof:height"), number("building:min_level", "min_level")
    height, lowest = parse_float(first("height")), parse_float(first("min_height"))
    usual = F.when(kind.isin("house", "detached", "duplex", "terrace"), 2.0).when(kind.isin("apartments", "office", "commercial", "retail", "hotel"), 4.0).otherwise(1.0)
    levels = F.when(given != 0, given).when(height.isNotNull(), F.greatest(F.lit(1.0), F.floor(height / LEVEL_M + 0.5))).when(area_m2 > 2000, 5.0).otherwise(usual)
    free = 20 + F.pmod(F.xxhash64(seed), F.lit(1000)) / 100
    tall = F.coalesce(height, F.when(kind.isin("church", "cathedral"), free).when(kind.isin("garage", "shed"), 3.5).when(kind == "roof", 4.0), (levels + roof_levels) * LEVEL_M)
    shape = F.coalesce(first("roof:shape", "building:roof:shape"), F.lit("flat"))
    roof = F.when((roof_given == 0) & (shape != "flat"), F.when(roof_levels > 0, roof_levels * LEVEL_M).otherwise(3.0)).otherwise(roof_given)
    return F.struct(levels.alias("levels"), tall.alias("height"), F.coalesce(lowest, F.when(low > 0, low * LEVEL_M), F.lit(0.0)).alias("min_height"), shape.alias("roof"), roof.alias("roof_height"))


def mask_half_width(tags: Column) -> Column:
    """Half width in metres of a road on the ground mask, null for ways off the ground or on foot."""
    off = _any(*[_has(tags, k) & ~_is(tags, k, "no") for k in ("bridge", "tunnel")], F.coalesce(F.nullif(tags["layer"], F.lit("0")) != "", F.lit(False)))
    out = F.when(_has(tags, "highway"), MASK_DEFAULT_M)
    for name, half in reversed(MASK_ROADS):
        out = F.when(_is(tags, "highway", name), half).otherwise(out)
    return F.when(~off & ~_is(tags, "highway", *MASK_SKIP), out)


def waterway_size(tags: Column) -> Column:
    """struct(width, depth) in metres of a waterway."""
    wide, deep = F.lit(10.0), F.lit(None).cast("double")
    for name, w, d in reversed(WATERWAYS):
        wide, deep = F.when(_is(tags, "waterway", name), w).otherwise(wide), F.when(_is(tags, "waterway", name), d).otherwise(deep)
    width = F.greatest(F.lit(3.0), F.coalesce(F.nullif(F.regexp_extract(tags["width"], r"(\d+\.?\d*|\.\d+)", 1), F.lit("")).cast("double"), wide))
    return F.struct(width.alias("width"), F.greatest(F.lit(1.5), F.coalesce(deep, F.greatest(F.lit(2.0), width * 0.25))).alias("depth"))


def error_kind(status: Column, name: Column, message: Column) -> Column:
    """struct(kind, retryable) of a failed request."""
    out = lambda kind, again: F.struct(F.lit(kind).alias("kind"), F.lit(again).alias("retryable"))
    return (
        F.when(status == 429, out("rate_limit", True))
        .when(status.isin(*RETRY_STATUS), out("http_server", True))
        .when(status.between(400, 499), out("http_client", False))
        .when(name == "AbortError", out("aborted", False))
        .when(message.rlike("(?i)timeout|network|fetch|ECONN|EAI_AGAIN|ENOTFOUND|ERR_"), out("network", True))
        .otherwise(out("unknown", True))
    )


def style_key(fields: list[Column]) -> Column:
    """A road's style as a JSON array of its fields; null is an empty text."""
    return F.to_json(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def segment_style_key(highway: Column, layer: Column, tags: Column) -> Column:
    return style_key([highway, layer, *[tags[k] for k in ("name", "ref", "width", "lanes", "lanes:forward", "lanes:backward", "oneway", "surface")]])


def corridor_style_key(highway: Column, layer: Column, tags: Column) -> Column:
    return style_key([highway, layer, *[tags[k] for k in ("name", "ref", "surface", "oneway")]])


def width_corridor_key(highway: Column, layer: Column, tags: Column) -> Column:
    """The corridor whose widths are kept alike; a road without a layer of its own takes that of its tags."""
    return style_key([F.coalesce(F.nullif(highway, F.lit("")), tags["highway"]), F.coalesce(layer, F.regexp_replace(road_layer(tags).cast("string"), r"\.0$", "")), *[tags[k] for k in ("name", "ref", "oneway")]])
