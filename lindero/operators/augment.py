"""Training data: corrupted spellings of addresses, junk texts, and how noisy texts are."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import STREETS, UNITS

# How likely each change is, before intensity and scale.
CHANCES = {
    "via_type": 0.75, "cross_type": 0.4, "quadrant": 0.55, "ordinal": 0.06, "unpad_plate": 0.3, "drop_complement": 0.55, "add_complement": 0.22, "replace_complement": 0.2,
    "hash": 0.65, "separator": 0.6, "drop_plate": 0.05, "glue_letters": 0.35, "glue_hash": 0.25, "glue_via": 0.12, "city": 0.18, "place": 0.1, "duplicate": 0.04,
    "lower": 0.3, "title": 0.12, "typo": 0.22, "double_space": 0.1,
}
# Patterns of what people write, as Java regular expressions.
PATTERNS = {
    "has_hash": "#",
    "has_dash": "-",
    "no_token": "(?i)\\b(No|Nro|Num|Numero|N)\\b\\.?|N°|Nº",
    "attached": "\\d[A-Za-z]",
    "via_spelled": "(?i)\\b(CALLE|CARRERA|AVENIDA|DIAGONAL|TRANSVERSAL|CIRCULAR|AUTOPISTA)\\b",
    "via_abbrev": "(?i)^\\W*(CL|CLL|CLLE|CR|CRA|KR|KRA|K|C|AV|AVDA|AC|AK|DG|DIAG|TV|TRV)\\b",
    "quadrant_spelled": "(?i)\\b(NORTE|SUR|ESTE|OESTE|ORIENTE|OCCIDENTE)\\b",
    "quadrant_abbrev": "(?i)(?<=\\d)\\s*(N|S|E|O|NTE|OE)\\b|\\b(NTE|OE)\\b",
    "double_plate": "\\d+\\s*[-#]\\s*\\d+.*\\d+\\s*[-#]\\s*\\d+",
    "complement": "(?i)\\b(APTO?|APT|AP|TORRE|TO|CASA|CS|LOCAL|LC|PISO|BLOQUE|BQ|INT|INTERIOR|CONJUNTO|CONJ|EDIF|EDIFICIO|OFICINA|OF|BODEGA|BG|MANZANA|MZ|LOTE|LT|URB|UNIDAD)\\b",
    "has_lowercase": "[a-z]",
    "city": "(?i)\\bCALI\\b",
}
_NO_SEPARATOR = "^\\W*[A-Za-z]{1,4}\\.?\\s*\\d+\\s*[A-Za-z]{0,3}\\s+\\d+\\s*[A-Za-z]{0,3}\\s+\\d+"
_JUNK = ["casa {0} esquina", "al lado de la tienda {0}", "finca {0}", "{0}{0}{0}", "vereda {0} sin numero", "frente al parque {0}", "tel {0}", "lote {0} via al mar", "no se", "barrio {0}", "{0} - {0}", "invasion {0}", "km {0} via", "casa color {0}"]


def patterns(c: Column) -> dict[str, Column]:
    found = {n: c.rlike(p) for n, p in PATTERNS.items()}
    found["missing_separators"] = ~c.rlike("[#-]") & c.rlike(_NO_SEPARATOR)
    return found


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """One row: the share of texts that have each pattern."""
    return df.agg(*[F.avg(p.cast("int")).alias(n) for n, p in patterns(F.coalesce(F.col(column), F.lit(""))).items()])


def scale(real: Column, made: Column, inverse: bool = False, eps: float = 0.01) -> Column:
    """How much more often a pattern is in real than in made texts, from a quarter to four times."""
    a, b = (1 - real, 1 - made) if inverse else (real, made)
    return F.greatest(F.lit(0.25), F.least(F.lit(4.0), (a + eps) / (b + eps)))


def corrupt(text: str, rng: random.Random, intensity: float = 1.0, scales: dict[str, float] | None = None) -> str:
    """A canonical address as somebody might have written it; typos last."""
    chance = lambda name: rng.random() < min(0.98, CHANCES[name] * intensity * (scales or {}).get(name, 1.0))
    head, mark, tail = text.partition(" # ")
    via, words = head.split(" "), tail.split(" ")
    if via[0] in STREETS and chance("via_type"):
        via[0] = rng.choice([*STREETS[via[0]], via[0]]).title() if rng.random() < 0.5 else rng.choice([*STREETS[via[0]], via[0]])
    if words[0] in STREETS and chance("cross_type"):
        words[0] = rng.choice([*STREETS[words[0]], words[0]])
    if chance("ordinal") and len(via) > 1 and via[1].isdigit():
        via[1] += {"1": "ra", "2": "da", "3": "ra"}.get(via[1][-1], "ta")
    if "-" in words:
        k = words.index("-")
        plate = k + 1 if k + 1 < len(words) else None
        if plate and words[plate].startswith("0") and chance("unpad_plate"):
            words[plate] = words[plate].lstrip("0") or "0"
        has_more = plate is not None and len(words) > plate + 1
        if has_more and chance("drop_complement"):
            words = words[: plate + 1]
        elif not has_more and chance("add_complement"):
            words += [rng.choice(list(UNITS)), str(rng.randint(1, 999))]
        if plate and chance("drop_plate"):
            del words[k : plate + 1]
        elif chance("separator"):
            words[k] = rng.choice(["-", " - ", "–", ""])
    if len(via) > 2 and chance("glue_letters"):
        via[1:3] = ["".join(via[1:3])]
    if chance("glue_via"):
        via = ["".join(via[:2]), *via[2:]]
    sign = rng.choice(["No.", "N°", "Nro", "no", ""]) if chance("hash") else "#"
    gap = "" if sign == "#" and chance("glue_hash") else " "
    out = " ".join(via) + (f"{gap}{sign}{gap or ''}" if mark else "") + " ".join(w for w in words if w)
    for name, more in (("city", ", Cali"), ("place", ", barrio " + rng.choice(["Centro", "Sur", "Norte"]))):
        if chance(name):
            out += more
    if chance("duplicate"):
        out = f"{out}; {out}"
    case = rng.random()
    out = out.lower() if case < 0.3 else out.title() if case < 0.42 else out
    for _ in range((1 + (rng.random() < 0.25)) if chance("typo") else 0):
        k = rng.randrange(max(1, len(out)))
        out = rng.choice([out[:k] + out[k + 1 :], out[:k] + out[k : k + 1] * 2 + out[k + 1 :], out[:k] + rng.choice("aeioumnrst") + out[k + 1 :]])
    return out.replace(" ", "  ", 1) if chance("double_space") else out


def variants(docs: DataFrame, n: int, seed: int, scales: dict[str, float] | None = None) -> DataFrame:
    """n corrupted spellings of each document (doc_id, direccion), the first one mild: doc_id, variant, text. Each depends on its id, number and seed only."""
    made = docs.select("doc_id", "direccion", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant")).withColumn("seed", F.xxhash64("doc_id", "variant", F.lit(seed)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["text"] = [corrupt(t or "", random.Random(s), 0.45 if v == 0 else 1.0, scales) for t, s, v in zip(f.direccion, f.seed, f.variant)]
            yield f[["doc_id", "variant", "text"]]

    return made.mapInPandas(run, "doc_id long, variant int, text string")


def junk(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n texts that are no addresses."""
    k = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(_JUNK))).cast("int")
    word = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(9999)).cast("string")
    return spark.range(n).select("id", F.replace(F.get(F.array(*map(F.lit, _JUNK)), k), F.lit("{0}"), word).alias("text"))


def held_out(docs: DataFrame, share: float = 0.04, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """docs with is_val for a fixed share of ids."""
    return docs.withColumn("is_val", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000))
