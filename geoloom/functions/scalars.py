"""Scalar column functions: numbers, parsing, text keys, hashes and formats.

Rounding is half toward plus infinity (floor(x * f + 0.5) / f) wherever a value is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_START, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF
NO_DATA = -99999.0


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def round_to(x: Column, places: int = 3) -> Column:
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, lo, hi) -> Column:
    """Null stays null, unlike greatest and least alone."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(t: Column) -> Column:
    c = clamp(t, 0.0, 1.0)
    return c * c * (3.0 - c * 2.0)


def smoothstep_between(lo, hi, x: Column) -> Column:
    return smoothstep((x - lo) / (hi - lo))


def parse_float(s: Column) -> Column:
    """The leading number of a text, as far as it goes; null if there is none."""
    got = F.regexp_extract(F.trim(s), r"^([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)", 1)
    return F.when(got != "", got.cast("double"))


def parse_int(s: Column) -> Column:
    got = F.regexp_extract(F.trim(s), r"^([-+]?\d+)", 1)
    return F.when(got != "", got.cast("bigint"))


def parse_positive_int(s: Column) -> Column:
    n = parse_int(s)
    return F.when(n > 0, n)


def count_delimited(s: Column) -> Column:
    """Non-blank tokens between bars; null if there are none."""
    n = F.size(F.filter(F.split(s, r"\|"), lambda x: F.trim(x) != ""))
    return F.when(s.isNotNull() & (n > 0), n)


def parse_width_m(s: Column) -> Column:
    """Metres of a width text: ft, m, or bare (over 40: feet); null unless positive."""
    raw = F.lower(F.trim(s))
    feet, metres, bare = parse_float(F.regexp_replace(raw, "ft", "")) * 0.3048, parse_float(F.regexp_replace(raw, "m", "")), parse_float(raw)
    got = F.when(F.instr(raw, "ft") > 0, feet).when(F.instr(raw, "m") > 0, metres).when(bare > 40, bare * 0.3048).otherwise(bare)
    return F.when(got > 0, got)


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over a text's code units (below 65536)."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.when(s == "", F.lit(FNV_START).cast("bigint")).otherwise(F.aggregate(codes, F.lit(FNV_START).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(MASK32))))


def fnv1a_hex(s: Column) -> Column:
    return F.lower(F.lpad(F.hex(fnv1a(s)), 8, "0"))


def fnv1a_base36(s: Column) -> Column:
    return F.lower(F.conv(fnv1a(s).cast("string"), 10, 36))


def sanitize_name(s: Column) -> Column:
    """Other than letters, digits and underscores become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_|_$", "")


def sanitize_file_part(s: Column) -> Column:
    got = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(s), "[^A-Za-z0-9_-]", "_"), "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(got, F.lit("")), F.lit("tile"))


def sanitize_folder(s: Column, fallback: str) -> Column:
    got = F.trim(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9 _.-]", " "), " +", " "))
    return F.coalesce(F.nullif(F.substring(got, 1, 96), F.lit("")), F.lit(fallback))


def tile_label(index: Column, cols) -> Column:
    cols = F.greatest(F.lit(1), F.lit(cols)) if not isinstance(cols, Column) else F.greatest(F.lit(1), cols)
    return F.concat(F.lit("R"), (F.floor(index / cols) + 1).cast("string"), F.lit("C"), (index % cols + 1).cast("string"))


def duration_text(ms: Column) -> Column:
    """h, m and s of a duration, the leading zero parts left out."""
    s = F.floor(ms / 1000).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    return F.when(h > 0, text(h, "h ", m, "m ", r, "s")).when(m > 0, text(m, "m ", r, "s")).otherwise(text(r, "s"))


def duration_ms_text(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(F.format_string("%.2f", ms / 1000), F.lit("s"))).otherwise(F.concat(js_round(ms).cast("string"), F.lit("ms")))


def number_text(x: Column, places: int = 3) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f", x), F.lit("n/a"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def decode_entities(s: Column) -> Column:
    """The five named entities of XML; the ampersand comes last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(sign))
    return s


def backoff_ms(attempt: Column, base: int = 1000, most: int = 30000) -> Column:
    """Without the random part."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))


def terrarium_height(r: Column, g: Column, b: Column) -> Column:
    """Metres of an elevation pixel; null where the tile has none."""
    h = r * 256 + g + b / 256 - 32768
    return F.when(h > -32760, h)


def unit_of_text(s: Column) -> Column:
    """Length unit named in a text; survey feet go before feet, feet before metres."""
    t = F.lower(s)
    has = lambda *w: t.rlike("|".join(w))
    return F.when(has("us survey", "survey foot", "us-ft", "ftus"), "us_survey_foot").when(has("foot", "feet", "ft"), "foot").when(has("metre", "meter"), "meter")


def unit_scale(unit: Column) -> Column:
    return F.when(unit == "foot", 0.3048).when(unit == "us_survey_foot", 1200.0 / 3937.0).otherwise(1.0)


def short_place(s: Column) -> Column:
    """The first three parts of a comma list."""
    parts = F.split(s, ",")
    return F.when(F.size(parts) <= 2, s).otherwise(F.concat_ws(", ", F.transform(F.slice(parts, 1, 3), lambda x: F.trim(x))))


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds to wait by a header: whole or broken seconds, or a date of the form that HTTP uses; null for anything else."""
    seconds = F.trim(value).try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.unix_millis(date) - F.unix_millis(now)
    wait = F.when(seconds.isNotNull() & ~F.isnan(seconds), F.floor(seconds * 1000)).otherwise(until)
    return F.when(wait.isNotNull(), F.greatest(F.lit(0), wait))


def strictly_true(value: Column) -> Column:
    """A boolean column's truth; null is not true."""
    return F.coalesce(value, F.lit(False))


def gml_name(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.endswith(".gml") | low.endswith(".xml")


def tile_key(key: Column) -> Column:
    """Whether a cache key is one of a map tile."""
    return F.coalesce(key.startswith("terr|") | key.startswith("sat|"), F.lit(False))


def token_like(text: Column) -> Column:
    """Three parts of base64url text joined by dots, the first two of which begin as JSON objects do in it."""
    return F.coalesce(F.trim(text).rlike(r"^eyJ[\w-]+\.[\w-]+\.[\w-]+$"), F.lit(False))


def rounded(value: Column, digits: int) -> Column:
    """A double rounded to so many digits, halves away from zero, in plain arithmetic on doubles - many times as fast as by decimals, which
    `round` goes through.  Null, NaN, infinite and very large values stay."""
    scale = float(10**digits)
    size = F.abs(value) * scale
    low = F.floor(size).cast("double")
    up = (low + F.when(size - low >= 0.5, 1.0).otherwise(0.0)) / scale
    return F.when(size < 2.0**52, F.when(value < 0, 0.0 - up).otherwise(up)).otherwise(value)
