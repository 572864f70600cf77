"""Which columns of a table hold the address, the place and what is to be kept."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.grammar import fold, token_set_ratio
from .errors import AddressColumnError, UsageError

# Names of address columns; the result's columns in order.
SYNONYMS = "direccion direcciones address domicilio dir direccion_predio direccion_residencia direccion_completa ubicacion nomenclatura".split()
RESULT = (
    "direccion_entrada estado motivo direccion_normalizada fuente_normalizacion numero_predial_nacional manzana lat lon confianza confiabilidad "
    "confiabilidad_manzana margen nivel_precision barrio_vereda comuna_corregimiento"
).split()
FLOOR, SURE, LEAD = 70.0, 85.0, 15.0


def find(name: str, columns: list[str]) -> str | None:
    """A column by its name, else without regard to case and outer spaces."""
    if name in columns:
        return name
    return next((c for c in columns if c.strip().lower() == name.strip().lower()), None)


def score_name(name: str) -> float:
    """How likely a name is that of an address column, 0 to 100."""
    plain = re.sub(r"[^a-z0-9]+", "_", fold(name).lower()).strip("_")
    if plain in SYNONYMS:
        return 100.0
    words = plain.split("_")
    whole = max((88.0 + min(7, len(s) / 2) for s in SYNONYMS if s in words), default=0.0)
    inner = max((78.0 + 9 * len(s) / max(1, len(plain)) for s in SYNONYMS if len(s) >= 4 and s in plain), default=0.0)
    fuzzy = 0.75 * max(token_set_ratio(plain.replace("_", " "), s.replace("_", " ")) for s in SYNONYMS)
    return round(max(whole, inner, fuzzy), 2)


def ranked_names(columns: list[str]) -> list[tuple[str, float]]:
    """Likely address columns, best first, equal ones in the table's order."""
    return sorted(((c, s) for c in columns if (s := score_name(c)) >= FLOOR), key=lambda x: -x[1])


def address_column(columns: list[str], wanted: str | None = None) -> str:
    if wanted is not None:
        found = find(wanted, columns)
        if found is None:
            raise UsageError(f"no column {wanted!r}; there are {columns}")
        return found
    ranks = ranked_names(columns)
    if not ranks:
        raise AddressColumnError("no column looks like an address", [])
    (name, best), second = ranks[0], ranks[1][1] if len(ranks) > 1 else 0.0
    if best == second or not (best == 100.0 or best >= SURE and best - second >= LEAD):
        raise AddressColumnError("no single column looks like an address", ranks)
    return name


@dataclass
class Mapping:
    """What is asked for: one address column or parts of it, a place, a municipality, and columns to keep (None: all)."""

    address: str | None = None
    parts: list[str] = field(default_factory=list)
    separator: str = " "
    lat: str | None = None
    lon: str | None = None
    municipality: str | None = None
    row_id: str | None = None
    keep: list[str] | None = None

    def resolve(self, columns: list[str]) -> Mapping:
        """The same with the table's own names; UsageError where they do not fit it."""
        def need(name: str | None) -> str | None:
            if name is None:
                return None
            if (found := find(name, columns)) is None:
                raise UsageError(f"no column {name!r}; there are {columns}")
            return found

        if self.address and self.parts:
            raise UsageError("either an address column or its parts, not both")
        if (self.lat is None) != (self.lon is None):
            raise UsageError("latitude and longitude go together")
        keep = list(columns) if self.keep is None else [need(c) for c in self.keep]
        row_id = need(self.row_id)
        if row_id and row_id not in keep:
            keep = [row_id, *keep]
        address = None if self.parts else address_column(columns, self.address)
        return Mapping(address, [need(p) for p in self.parts], self.separator, need(self.lat), need(self.lon), need(self.municipality), row_id, keep)

    def text(self) -> Column:
        """The address text of each row of the resolved mapping's table."""
        return C.concat_parts(*[F.col(f"`{p}`") for p in self.parts], sep=self.separator) if self.parts else C.part_text(F.col(f"`{self.address}`"))


def layout(kept: list[str], result: list[str] = RESULT) -> dict[str, str]:
    """New names of kept columns that clash with the result's: <name>_original, and _ until free; lat and lon as a pair."""
    taken = set(kept) | set(result)
    clash = [c for c in kept if c in result]
    if {"lat", "lon"} & set(clash):
        clash += [c for c in ("lat", "lon") if c in kept and c not in clash]
    out = {}
    for c in clash:
        name = f"{c}_original"
        while name in taken:
            name += "_"
        taken.add(name)
        out[c] = name
    return out


def applied(df: DataFrame, m: Mapping) -> DataFrame:
    """df with raw (the address text), outside, and the kept columns under their final names."""
    names = layout(m.keep or [])
    outside = C.is_outside(F.col(f"`{m.municipality}`")) if m.municipality else F.lit(False)
    return df.select(m.text().alias("raw"), outside.alias("outside"), *[F.col(f"`{c}`").alias(names.get(c, c)) for c in m.keep or []])


# Options and their ranges.
RANGES = {"min_struct": (0.0, 1.0), "threshold": (0.0, 1.0), "plate_tolerance": (0, 2), "ambiguity_delta": (0.0, 0.2), "buffer_barrio_m": (0.0, 1e9), "buffer_comuna_m": (0.0, 1e9)}


def load_config(path: str) -> dict:
    """Options of a TOML file, sections flattened; unknown ones and values out of range are errors."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    flat = {k: v for name, value in data.items() for k, v in (value.items() if isinstance(value, dict) else [(name, value)])}
    known = set(RANGES) | {"address", "parts", "separator", "lat", "lon", "municipality", "row_id", "keep", "format", "output", "limit", "encoding", "delimiter", "sheet", "header_row", "table"}
    if bad := sorted(set(flat) - known):
        raise UsageError(f"unknown options: {', '.join(bad)}")
    for k, (low, high) in RANGES.items():
        if k in flat and not (isinstance(flat[k], (int, float)) and low <= flat[k] <= high):
            raise UsageError(f"{k} must be from {low} to {high}")
    return flat


def merged(*layers: dict) -> dict:
    """Later layers over earlier ones; None does not count."""
    return {k: v for layer in layers for k, v in layer.items() if v is not None}
