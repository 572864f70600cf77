"""The matching pipeline on a small catalogue."""

import json

import pytest
from pyspark.sql import functions as F

from lindero import cli
from lindero.functions import columns as C
from lindero.operators import decision, evaluation
from lindero.plans.pipeline import normalize

DOCS = [(0, "CL 5 # 10 - 20", "M1", "P0", -76.55, 3.45), (1, "CL 5 # 10 - 24", "M2", "P1", -76.55, 3.45), (2, "KR 7 A # 3 - 08", "M3", "P2", -76.45, 3.45), (3, "CL 5 # 40 - 90", "M4", "P3", -76.45, 3.45)]
TEXTS = {
    1: ("Calle 5 No. 10-20", "OK", 0), 2: ("CL 5 # 10 - 20", "OK", 0), 3: ("Cra 7A # 3-08, Cali", "OK", 2), 4: ("N/A", "SIN_MATCH", None), 5: (None, "SIN_MATCH", None),
    6: ("casa azul", "NO_PARSEABLE", None), 7: ("CL 99 # 1 - 1", "SIN_MATCH", None), 8: ("Calle 5 No. 10-20", "OK", 0), 9: ("KR 7 B # 3 - 08", "SIN_MATCH", None),
}


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, direccion string, manzana string, numero_predial_nacional string, centroid_lon double, centroid_lat double")
    return d.withColumns({"n_predios": F.lit(1), "manzana_nunique": F.lit(1)})


def test_statuses_and_documents(spark, docs):
    texts = spark.createDataFrame([(k, t[0]) for k, t in TEXTS.items()], "row_id long, raw string")
    got = {r.row_id: r for r in normalize(texts, docs, threshold=0.7).collect()}
    assert set(got) == set(TEXTS)
    for k, (_, status, doc) in TEXTS.items():
        assert (got[k].estado, got[k].doc_id) == (status, doc), (k, got[k])
    assert got[1].direccion_normalizada == "CL 5 # 10 - 20" and got[1].fuente_normalizacion == "catastro"
    assert got[7].fuente_normalizacion == "reglas" and got[4].direccion_normalizada is None
    # With a margin to keep, two neighbours that are nearly alike are told apart by their rules alone.
    strict = {r.row_id: r.estado for r in normalize(texts, docs, threshold=0.7, delta=0.02).collect()}
    assert strict[1] == strict[8] == "OK"


def test_places_are_cut_out_and_gate(spark, docs):
    box = lambda x0, x1: [[(x0, 3.4), (x1, 3.4), (x1, 3.5), (x0, 3.5)]]
    features = spark.createDataFrame([("barrio", "MIRAFLORES", None, box(-76.6, -76.5)), ("barrio", "ALAMEDA", None, box(-76.5, -76.4))], "kind string, name string, parent string, rings array<array<struct<x:double,y:double>>>")
    texts = spark.createDataFrame([(1, "CL 5 # 10 - 20, barrio Miraflores"), (2, "CL 5 # 10 - 20, barrio Alameda"), (3, "CL 5 # 10 - 20")], "row_id long, raw string")
    got = {r.row_id: r for r in normalize(texts, docs, threshold=0.7, features=features, cell=0.05).collect()}
    assert (got[1].estado, got[1].doc_id, got[1].barrio_vereda) == ("OK", 0, "MIRAFLORES")
    assert got[2].estado == "SIN_MATCH" and got[2].doc_id is None and got[2].barrio_vereda == "ALAMEDA"
    assert (got[3].estado, got[3].doc_id, got[3].barrio_vereda) == ("OK", 0, None)


def test_a_text_that_fails_is_a_row(monkeypatch):
    def broken(text):
        raise ValueError("bad\n text " + "x" * 300)

    monkeypatch.setattr(C.grammar, "parse", broken)
    got = dict(zip(C._FIELDS, C._address.__wrapped__("CL 5 # 10 - 20")))
    assert got["parse_ok"] is False and got["notes"][0].startswith(C.FAILED + "ValueError: bad") and got["canonical"] is None
    monkeypatch.setattr(C.grammar, "parse", lambda text: (_ for _ in ()).throw(MemoryError()))
    with pytest.raises(MemoryError):
        C._address.__wrapped__("CL 5 # 10 - 20")


def test_error_rows(spark):
    none = F.array().cast("array<string>")
    rows = spark.createDataFrame([(1, ["error: ValueError: bad\n\n text"]), (2, ["no_alphabetic_content"]), (3, [])], "row_id long, notes array<string>").withColumns({
        "outside": F.lit(False), "municipality": F.lit(""), "placeholder": F.lit(False), "parse_ok": F.lit(False), "score": F.lit(None).cast("double"), "gated": F.lit(None).cast("string"), "hard": none, "soft": none,
        "margen_manzana": F.lit(None).cast("double"), "n_competidores": F.lit(0), "n_predios": F.lit(1), "manzana_nunique": F.lit(1), "level": F.lit("predio"),
    })
    got = {r.row_id: (r.estado, r.motivo) for r in decision.decided(rows, 0.7).collect()}
    assert got == {1: ("ERROR", "ValueError: bad text"), 2: ("NO_PARSEABLE", "no_alphabetic_content"), 3: ("NO_PARSEABLE", "gramatica de direccion no reconocida")}


@pytest.mark.parametrize("n", [0, 1, 3, 17])
def test_equal_bins_are_tiles(spark, n):
    rows = spark.range(0, n, 1, 3).withColumn("p", F.col("id") * 7 % 5)
    got = {r.id: r.bin for r in evaluation.equal_bins(rows, 5, ("p", "id")).collect()}
    order = sorted(range(n), key=lambda i: (i * 7 % 5, i))
    want, at = {}, 0
    for b in range(5):
        for _ in range(n // 5 + (b < n % 5)):
            want[order[at]] = b + 1
            at += 1
    assert got == want


def test_the_command_counts_every_row(spark, docs, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("direccion,municipio\nCL 5 # 10 - 20,Cali\nN/A,Cali\nCL 5 # 10 - 24,Palmira\nCra 7A # 3-08,Cali\n")
    whole = docs.withColumns({"comuna": F.lit("01"), "barrio": F.lit("01"), "barrio_code": F.lit("0101"), "objectid": F.col("doc_id")})
    a = cli.parser().parse_args(["normalize", str(source), "--output", str(tmp_path / "out.jsonl"), "--address", "direccion", "--municipality", "municipio", "--threshold", "0.7"])
    out = cli.run_normalize(spark, a, whole)
    assert out["rows"] == 4 and out["by_status"] == {"OK": 2, "SIN_MATCH": 1, "FUERA_DE_AREA": 1}
    rows = [json.loads(line) for line in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert [r["estado"] for r in rows] == ["OK", "SIN_MATCH", "FUERA_DE_AREA", "OK"]
