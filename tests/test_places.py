import pyarrow as pa
from pyspark.sql import functions as F

from lindero.functions.places import Gazetteer, detected, detector, key_of

ROWS = [("barrio", "Granada", "2"), ("barrio", "Nueva Granada", "19"), ("barrio", "Belalcázar", "9"), ("barrio", "Navarro", "8"), ("vereda", "La Reforma", "Los Andes"), ("vereda", "La Reforma", "La Buitrera"), ("corregimiento", "Los Andes (Cabecera)", None), ("corregimiento", "Navarro", None)]
G = Gazetteer.of(ROWS)


def test_keys():
    assert key_of("Los Andes (Cabecera)") == "LOS ANDES" and key_of(None) == ""


def test_labels_and_parts():
    d = G.detect("CL 5 # 3 - 20 barrio Belalcazer")
    assert (d.barrio, d.comuna, d.cleaned_text) == ("Belalcázar", 9, "CL 5 # 3 - 20") and d.notes == ["comuna_from_barrio"]
    d = G.detect("CL 5 # 3 - 20, Nueva Granada, Cali")
    assert d.barrio == "Nueva Granada" and d.cleaned_text == "CL 5 # 3 - 20"
    d = G.detect("KR 1 # 2 - 3, comuna 4, barrio granada")
    assert d.comuna == 4 and "comuna_barrio_conflict" in d.notes
    assert G.detect("comuna 40").notes == ["comuna_out_of_range"]
    # An unlabelled name that several kinds have is the widest one.
    d = G.detect("CL 5 # 3 - 20, Navarro")
    assert d.corregimiento == "Navarro" and d.barrio is None
    assert G.detect("vereda la reforma").corregimiento == "Los Andes"


def test_nothing_found_is_kept():
    for t in ("CL 5 # 3 - 20", "", None, "  ", "KR 26 B # 1 - 2"):
        d = G.detect(t)
        assert d.cleaned_text == (t or "") and not d.barrio


def test_column(spark):
    detect = detector(spark, spark.createDataFrame(ROWS, "kind string, name string, parent string"))
    r = spark.createDataFrame([("KR 1 # 2 - 3 granada",), (None,)], "t string").select(detect(F.col("t")).alias("d")).select("d.*").collect()
    assert r[0].barrio == "Granada" and r[0].comuna == 2 and r[1].barrio is None


def test_equal_texts_are_detected_once(spark, monkeypatch):
    asked, detect = [], Gazetteer.detect
    monkeypatch.setattr(Gazetteer, "detect", lambda self, raw: asked.append(raw) or detect(self, raw))
    column = detector(spark, spark.createDataFrame(ROWS, "kind string, name string, parent string"))
    texts = ["KR 1 # 2 - 3 granada", None, "KR 1 # 2 - 3 granada", "barrio belalcazer", None]
    for _ in range(2):
        rows = column.func(pa.array(texts, pa.string())).to_pylist()
        assert rows == [vars(detect(G, t)) for t in texts]
    assert sorted(asked, key=str) == sorted(set(texts), key=str)


def test_detected_rows(spark):
    texts = [(k, ("CL 5 # 3 - 20, Navarro", "barrio belalcazer", None)[k % 3]) for k in range(30)]
    rows = detected(spark.createDataFrame(texts, "row_id long, text string"), "text", spark.createDataFrame(ROWS, "kind string, name string, parent string")).collect()
    assert sorted((r.row_id, r.text) for r in rows) == texts
    assert all((r.d.corregimiento, r.d.barrio) == (("Navarro", None), (None, "Belalcázar"), (None, None))[r.row_id % 3] for r in rows)
