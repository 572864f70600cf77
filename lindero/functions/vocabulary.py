"""Word lists of the address grammar."""

from __future__ import annotations

# Spellings of street kinds, in the order in which typo repair compares them.
STREETS = {
    "CL": "CALLE CALLES CLL CLLE CLE CALL CAL C CLA".split(),
    "KR": "CARRERA CARRERAS CRA CR CRR CRRA KRA KRR KAR CARR CARERA CARREA K".split(),
    "AV": "AVENIDA AVDA AVE AVN AVEN A".split(),
    "AC": ["AVENIDA CALLE", "AVCL", "AV CALLE", "AVC", "AV CL"],
    "AK": ["AVENIDA CARRERA", "AVKR", "AV CARRERA", "AVK", "AV KR", "AV CRA"],
    "DG": "DIAGONAL DIAG DIGONAL D".split(),
    "TV": "TRANSVERSAL TRANSV TRANV TRV TRAV TRANSVESAL T".split(),
    "PJ": "PASAJE PSJ PJE".split(),
    "PS": ["PASEO"],
    "CV": "CIRCUNVALAR CIRCUNV CIRC".split(),
    "AU": "AUTOPISTA AUTOP".split(),
    "CT": ["CALLEJON"],
}
# Spellings of cardinal points after a street number.
CARDINALS = {"NORTE": "NTE NOR NORT".split(), "SUR": [], "ESTE": ["EST"], "OESTE": ["OES", "OESTE.", "WEST"]}
# Short spellings that are cardinal points only behind a number.
SHORT_CARDINALS = {"OE": "OESTE", "NTE": "NORTE"}
# Spellings of units inside a lot.
UNITS = {
    "AP": "APTO APARTAMENTO APT APA APARTAMENT APTO.".split(),
    "TO": "TORRE TOR TORR".split(),
    "LC": "LOCAL LOC LCL".split(),
    "CA": "CASA CS".split(),
    "ET": "ETAPA ETP".split(),
    "BLQ": "BLOQUE BL BLK BQ".split(),
    "MZ": "MANZANA MZN MZA".split(),
    "LT": "LOTE LOT".split(),
    "PH": ["PENTHOUSE"],
    "OF": "OFICINA OFC OFI".split(),
    "ED": "EDIFICIO EDIF EDF".split(),
    "CONJ": "CONJUNTO CJTO CONJT".split(),
    "UR": "URBANIZACION URB".split(),
    "INT": "INTERIOR IN".split(),
    "PQ": "PARQUEADERO PARQ".split(),
    "GA": "GARAJE GAR".split(),
    "BG": "BODEGA BOD".split(),
    "BR": "BARRIO BRR".split(),
    "CGTO": "CORREGIMIENTO CORR".split(),
    "VDA": ["VEREDA"],
}
# What may follow an address without saying where it is.
CITY = ["CALI", "SANTIAGO DE CALI", "VALLE DEL CAUCA", "VALLE", "COLOMBIA", "V/CAUCA", "VALLE DEL CAUCA COLOMBIA", "CAUCA", "VALLE CAUCA"]
# Spellings of the mark of a second street of one number.
BIS = ["BIS", "BS", "BISS"]
# Endings of ordinal numbers.
ORDINALS = "RA RO TA TO DA DO MA MO NA ER ERA VA VO".split()
# Weights of the parts of two addresses in their agreement.
WEIGHTS = {
    "via_number": 2.0, "cross_number": 2.0, "plate": 1.5, "via_type": 1.0, "via_letters": 1.0, "cross_letters": 1.0,
    "via_quadrant": 0.75, "cross_quadrant": 0.75, "via_bis": 0.75, "cross_bis": 0.75, "cross_type": 0.5,
}


def spellings(groups: dict[str, list[str]]) -> dict[str, str]:
    """Each spelling and each canonical word to its canonical word."""
    return {word: canon for canon, others in groups.items() for word in (canon, *others)}


STREET_OF, CARDINAL_OF, UNIT_OF = spellings(STREETS), spellings(CARDINALS), spellings(UNITS)
LONG_STREETS = [w for w in STREET_OF if len(w) >= 4 and w.isalpha()]
