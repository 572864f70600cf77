"""Column functions of the engine. All but the last group are built-in expressions; those at the end
are Arrow functions, for what the built-ins cannot express (the grammar's state machine and the
similarity of word sets)."""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grammar
from .vocabulary import CARDINALS, LONG_STREETS, STREET_OF, UNIT_OF, WEIGHTS

# Cells that say nothing.
PLACEHOLDERS = [
    "", "-", "--", ".", "0", "00", "N/A", "NA", "N.A", "N.A.", "NAN", "NONE", "NULL",
    "NO APLICA", "NO REGISTRA", "NO REPORTA", "NO INFORMA", "NINGUNA", "NINGUNO",
    "SIN ESPECIFICAR", "SIN DATO", "SIN DATOS", "SIN DIRECCION", "SIN INFORMACION",
    "S/D", "S.D", "SD", "DESCONOCIDA", "DESCONOCIDO", "NO TIENE", "NO HAY", "X", "XX", "XXX",
]
# Words of a municipality's name that do not tell which one it is.
MUNICIPALITY_FILLERS = "municipio distrito especial de del d e c dc co valle cauca colombia departamento".split()
# Mean radius of the earth and scale of geographic decay, in metres.
EARTH_M, DECAY_M = 6_371_008.8, 600.0

#: Letters of the Latin blocks with their decomposition's base letter.
_FOLDS = {c: b for c in map(chr, range(0xA0, 0x250)) if len(b := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and b != c and b.isascii()}


def fold(c: Column) -> Column:
    """Without accents; letters of the Latin blocks, and combining marks anywhere."""
    return F.translate(F.regexp_replace(c, "\\p{M}+", ""), "".join(_FOLDS), "".join(_FOLDS.values()))


def match_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]", "")


#: The grammar's rewriting rules, in Java's spelling of a letter or digit of any script.
_CLEAN = [(pattern.replace(r"\w", r"\p{L}\p{N}_"), to) for pattern, to in grammar.REWRITES]


def clean(c: Column) -> Column:
    """Upper case, plain letters, one spelling of dashes and number words, single spaces."""
    out = F.upper(fold(c))
    for pattern, to in _CLEAN:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


#: A well-formed address, as clean() leaves it.
FAST = "^(CL|KR|AV|AC|AK|DG|TV|PJ|PS|CV|AU|CT) 0*(\\d{1,4})( [A-Z])? # 0*(\\d{1,4})( [A-Z])? - (\\d{1,6})$"


def canonical_fast(c: Column) -> Column:
    """The canonical form of well-formed texts, null for others, which take the grammar.

    Each step names its input once, so the rules run once a row: what does not fit becomes the form's
    constant parts alone, and these become null.
    """
    out = F.regexp_replace(clean(c), f"{FAST}|^[\\s\\S]*$", "$1 $2$3 # $4$5 - $6")
    out = F.regexp_replace(F.regexp_replace(out, "(?<= - )(?=\\d$)", "0"), "(?<= - )0+(?=\\d\\d$)", "")
    return F.nullif(out, F.lit("  #  - "))


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is computed once a row, however often it is used: filters on it, and those that joins add, are not moved before it with copies of what it takes."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def is_placeholder(c: Column) -> Column:
    """Cells that say nothing: a marker, or no letter and fewer than three digits. Null is one."""
    key = F.upper(collapsed(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^\\x00-\\x7F]", "")))
    return key.isin(PLACEHOLDERS) | (~key.rlike("[A-Z]") & (F.length(F.regexp_replace(key, "[^0-9]", "")) < 3))


def is_outside(c: Column, name: tuple[str, ...] = ("cali",), other: tuple[str, ...] = ("cali", "santiago"), code: str = "76001", postal: str = "7600") -> Column:
    """Whether a municipality cell names another one than ours; markers and mere numbers do not."""
    text = F.trim(F.lower(F.regexp_replace(fold(c.cast("string")), "[^\\x00-\\x7F]", "")))
    digits = F.regexp_replace(F.regexp_replace(text, "^(\\d+)[.,]0+$", "$1"), "[^0-9]", "")
    own = digits.isin(code, code + "000") | digits.rlike(f"^{postal}\\d\\d$")
    tokens = F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda x: (x != "") & ~x.isin(MUNICIPALITY_FILLERS))
    words = F.filter(tokens, lambda x: ~x.rlike("^\\d+$"))
    names = F.array_sort(F.array_distinct(words))
    ours = (names == F.array(*map(F.lit, sorted(name)))) | (names == F.array(*map(F.lit, sorted(other))))
    named = F.when(F.size(words) > 0, ~ours).otherwise((F.size(tokens) > 0) & ~F.forall(tokens, lambda x: x.isin(code, code + "000")))
    numeric = ~own & F.length(digits).isin(5, 8)
    return F.when(c.isNull() | is_placeholder(c.cast("string")), False).otherwise(F.when(text.rlike("^\\d[\\d.,\\s-]*$"), numeric).otherwise(named))


def part_text(c: Column) -> Column:
    """A cell as text: whole floats without .0, blanks null."""
    return F.nullif(F.trim(F.regexp_replace(c.cast("string"), "^(-?\\d+)\\.0$", "$1")), F.lit(""))


def concat_parts(*cells: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *map(part_text, cells))


def clean_double(c: Column) -> Column:
    """A number with NaN and infinities as null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_double(c: Column) -> Column:
    """Text to number, decimal commas included; null where it is none."""
    return clean_double(F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double"))


def nearest(word: Column, among: list[str], canon: dict[str, str]) -> Column:
    """Typo repair: the first of the nearest words, if it is near for its length."""
    tries = F.array(*[F.struct(F.levenshtein(word, F.lit(w)).alias("d"), F.lit(k).alias("k"), F.lit(canon[w]).alias("to"), F.lit(max(1, len(w) // 4)).alias("most")) for k, w in enumerate(among)])
    best = F.array_min(tries)
    return F.when((F.length(word) >= 4) & (best["d"] <= best["most"]), best["to"])


def nearest_street(word: Column) -> Column:
    return F.when(word.rlike("^[A-Z]+$"), nearest(word, LONG_STREETS, STREET_OF))


def nearest_cardinal(word: Column) -> Column:
    return nearest(word, list(CARDINALS), {w: w for w in CARDINALS})


def unit_words(c: Column) -> Column:
    """A complement with its unit words canonical."""
    known = F.create_map(*[F.lit(x) for pair in UNIT_OF.items() for x in pair])
    return F.array_join(F.transform(F.split(collapsed(c), " "), lambda w: F.coalesce(known[w], w)), " ")


def digits_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "^\\s*(\\d+)", 1), F.lit("")).cast("long")


def zone_label(c: Column, prefix: str = "Comuna") -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t.rlike("^\\d+$"), F.concat(F.lit(prefix + " "), t.cast("int").cast("string"))).otherwise(F.nullif(t, F.lit("")))


def codes_equal(a: Column, b: Column) -> Column:
    """Equality of codes padded with zeros; null where either is absent."""
    x, y = (F.nullif(F.trim(c.cast("string")), F.lit("")) for c in (a, b))
    n = F.greatest(F.length(x), F.length(y))
    return F.lpad(x, n, "0") == F.lpad(y, n, "0")


def plate_agrees(a: Column, b: Column) -> Column:
    """Equality of plates but for leading zeros; null where either is absent."""
    return F.ltrim(F.nullif(a, F.lit("")), F.lit("0")) == F.ltrim(F.nullif(b, F.lit("")), F.lit("0"))


# ---- numbers ------------------------------------------------------------------------------------


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere; null where a coordinate is null or no number."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(F.isnan(a), None).when(a > 1, 1.0).otherwise(a)))


def to_metric(lon: Column, lat: Column, lon0: float = -74.07750791666666, lat0: float = 4.596200416666666, false_east: float = 1e6, false_north: float = 1e6) -> tuple[Column, Column]:
    """Transverse Mercator on the GRS80 ellipsoid, in metres (Redfearn's series)."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    c = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072]
    p0 = math.radians(lat0)
    m0 = a * (c[0] * p0 - c[1] * math.sin(2 * p0) + c[2] * math.sin(4 * p0) - c[3] * math.sin(6 * p0))
    p = F.radians(lat)
    m = a * (c[0] * p - c[1] * F.sin(2 * p) + c[2] * F.sin(4 * p) - c[3] * F.sin(6 * p))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    t, cc, w = F.pow(F.tan(p), 2), ep2 * F.pow(F.cos(p), 2), F.radians(lon - lon0) * F.cos(p)
    east = false_east + n * (w + (1 - t + cc) * F.pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep2) * F.pow(w, 5) / 120)
    north = false_north + m - m0 + n * F.tan(p) * (w * w / 2 + (5 - t + 9 * cc + 4 * cc * cc) * F.pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep2) * F.pow(w, 6) / 720)
    return east, north


def geo_decay(dx: Column, dy: Column, scale: float = DECAY_M) -> Column:
    return F.exp(-F.hypot(dx, dy) / scale)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def standardised(x: Column, mean: float, std: float, most: float = 5.0) -> Column:
    """Deviations from the mean, missing values at the mean, clipped."""
    z = F.coalesce((clean_double(x) - mean) / (std or 1.0), F.lit(0.0))
    return F.greatest(F.lit(-most), F.least(F.lit(most), z))


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Straight lines between knots, flat beyond them; a missing x is at the lowest knot."""
    out = F.when(x.isNull() | F.isnan(x) | (x <= xs[0]), F.lit(float(ys[0])))
    for a, b, p, q in zip(xs, xs[1:], ys, ys[1:]):
        if b > a:
            out = out.when(x <= b, p + (q - p) * (x - a) / (b - a))
    return out.otherwise(F.lit(float(ys[-1])))


def least_precise(*levels: Column, order: tuple[str, ...] = ("direccion", "via", "esquina", "manzana", "predio")) -> Column:
    ranks = F.array(*map(F.lit, order))
    at = F.array_min(F.filter(F.array(*[F.array_position(ranks, x) for x in levels]), lambda k: k > 0))
    return F.get(ranks, (at - 1).cast("int"))


def struct_agreement(a: Column, b: Column) -> Column:
    """Weighted share of the parts in which two parsed addresses agree; parts that neither has do not count."""
    total, got = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.items():
        x, y = a[name], b[name]
        absent = (~x & ~y) if name.endswith("_bis") else (x.isNull() & y.isNull())
        total = total + F.when(absent, 0.0).otherwise(w)
        same = F.when(x.eqNullSafe(y), w)
        if name == "plate":
            near = F.abs(x.try_cast("int") - y.try_cast("int")) <= 2
            same = same.when(plate_agrees(x, y), w).when(near, 0.4 * w)
        got = got + F.when(absent, 0.0).otherwise(same.otherwise(0.0))
    return F.when(total > 0, got / total).otherwise(0.0)


def fused(sim: Column, fuzz: Column, struct: Column, geo: Column, w: dict[str, float]) -> Column:
    """Weighted sum; where geo is missing its weight goes to the other three in equal parts."""
    third = w["geo"] / 3
    with_geo = w["sim"] * sim + w["fuzz"] * fuzz + w["struct"] * struct + w["geo"] * geo
    return F.when(clean_double(geo).isNotNull(), with_geo).otherwise((w["sim"] + third) * sim + (w["fuzz"] + third) * fuzz + (w["struct"] + third) * struct)


def reason_stem(c: Column) -> Column:
    """A reason up to its first variable word."""
    words = F.split(F.trim(F.coalesce(c, F.lit(""))), " ")
    stops = lambda w: w.rlike("[:<0-9]") | F.lower(F.regexp_replace(w, "^[.,;]+|[.,;]+$", "")).isin("barrio", "comuna", "corregimiento") | F.regexp_replace(w, "^[.,;]+|[.,;]+$", "").rlike("^\\p{Lu}+$")
    kept = F.aggregate(words, F.struct(F.lit("").alias("t"), F.lit(True).alias("go")), lambda s, w: F.when(s["go"] & ~stops(w), F.struct(F.concat(s["t"], F.lit(" "), w).alias("t"), F.lit(True).alias("go"))).otherwise(F.struct(s["t"].alias("t"), F.lit(False).alias("go"))))
    return F.coalesce(F.nullif(F.trim(kept["t"]), F.lit("")), F.lit("(vacio)"))


def zone_of(polygon: Column, told: Column, code: Column) -> Column:
    """The zone of a match: of the polygon that covers it, else as the text says, else by its code; blanks do not count."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (polygon, told, code)])


def query_text(canonical: Column, raw: Column, most: int = 40) -> Column:
    """What is sought for a text: its canonical form, else the cleaned text, cut to what an encoder reads."""
    return F.left(F.coalesce(F.nullif(canonical, F.lit("")), clean(F.coalesce(raw, F.lit("")))), F.lit(most))


# The symbols an encoder reads, numbered from 2 (0 pads, 1 stands for any other), and how many it reads.
SYMBOLS, MAX_CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 #-.,/'()|", 48


def char_codes(c: Column, most: int = MAX_CODES) -> Column:
    """A text (already in capitals) as so many symbol numbers, cut or padded; a null text is all padding."""
    text = F.left(F.coalesce(c, F.lit("")), F.lit(most))
    place = lambda x: F.when(F.instr(F.lit(SYMBOLS), x) > 0, F.instr(F.lit(SYMBOLS), x) + 1).otherwise(1)
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), place)
    return F.concat(codes, F.array_repeat(F.lit(0), most - F.size(codes)))


def weighted_place(candidates: Column) -> Column:
    """The mean (lon, lat) of candidates (score, lon, lat), weighted by their positive scores; null where none has a place and a score."""
    known = F.filter(candidates, lambda x: x["lon"].isNotNull() & x["lat"].isNotNull() & (x["score"] > 0))
    total = lambda f: F.aggregate(known, F.lit(0.0), lambda s, x: s + f(x))
    weight = F.nullif(total(lambda x: x["score"]), F.lit(0.0))
    return F.struct(*[(total(lambda x, n=n: x["score"] * x[n]) / weight).alias(n) for n in ("lon", "lat")])


def short_message(c: Column, most: int = 200) -> Column:
    """A message in one line, cut, with dots where something was cut off."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, "...").otherwise(""))


# ---- Arrow functions ----------------------------------------------------------------------------

_STREET = ["type", "number", "letters", "suffix", "suffix_letters", "bis", "quadrant"]
_FIELDS = ["parse_ok", *(f"{side}_{n}" for side in ("via", "cross") for n in _STREET), "plate", "complement", "had_hash", "had_plate_sep", "notes", "canonical", "canonical_base"]
_BOOLEAN = {"parse_ok", "via_bis", "cross_bis", "had_hash", "had_plate_sep"}
ADDRESS = T.StructType([T.StructField(f, T.BooleanType() if f in _BOOLEAN else T.ArrayType(T.StringType()) if f == "notes" else T.StringType()) for f in _FIELDS])


#: How the only note of a text starts whose reading failed.
FAILED = "error: "


@functools.lru_cache(1 << 16)
def _address(text: str | None) -> tuple:
    try:
        a = grammar.parse(text)
    except MemoryError:
        raise
    except Exception as e:  # one text must not end the job: its row tells what failed
        return tuple(False if f in _BOOLEAN else [f"{FAILED}{type(e).__name__}: {e}"] if f == "notes" else None for f in _FIELDS)
    row = a.flat() | {"canonical": a.canonical(), "canonical_base": a.canonical(with_complement=False)}
    return tuple(row[f] for f in _FIELDS)


@F.pandas_udf(ADDRESS)
def parse_address(texts: pd.Series) -> pd.DataFrame:
    """The parts of each address; a Python worker parses a text that repeats once."""
    return pd.DataFrame([_address(t) for t in texts], columns=_FIELDS)


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([grammar.token_set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def filter_complement(catalogued: pd.Series, told: pd.Series) -> pd.Series:
    return pd.Series([grammar.filter_complement(x, y) for x, y in zip(catalogued, told)])


@F.pandas_udf(T.StringType())
def address_key(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(grammar.address_key, na_action=None)


def register(spark: SparkSession) -> None:
    """Makes the Arrow functions known to SQL."""
    for name, f in (("parse_address", parse_address), ("token_set_ratio", token_set_ratio), ("filter_complement", filter_complement), ("address_key", address_key)):
        spark.udf.register(name, f)
