"""Literal cases for the text rules and their corner cases."""

import pytest
from pyspark.sql import functions as F

from fichero.functions import dates, text
from fichero.functions.labels import field_of
from fichero.operators.ordered import with_rank
from fichero.plans import checklist, extraction, licences, quality


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_text_rules(spark):
    c = F.col("c")
    assert one(spark, text.py_trim(c), c=" \t a b \n") == "a b"
    assert one(spark, text.label_key(c), c="  Nº de\nRADICACIÓN:  (e) ") == "N DE RADICACION E"
    assert one(spark, text.placeholder_key(c), c=" Año emisión ") == "ANO_EMISION"
    assert one(spark, text.strip_accents(c), c="é ñ ü") == "e n u"
    assert [one(spark, text.placeholder_empty(c), c=v) for v in ("", " no registra ", "No Aplica", "x")] == [True, True, True, False]
    assert one(spark, text.output_name(c, F.lit("77")), c="foo.docx") == "77_LICENCIA"
    assert one(spark, text.output_name(c, F.lit("77")), c="1_ana_CHECKLIST.docx") == "77_ana_LICENCIA"
    assert one(spark, text.licence_category(c), c="CATEGORIA I") is None
    assert one(spark, text.licence_category(c), c="categoría ii") == text.CATEGORY_2


def test_filing_number_head_only(spark):
    late = "\n".join(["x"] * 50 + ["Radicado: 123456"])
    assert one(spark, text.filing_number(F.col("n"), F.col("t"), first_lines=50), n="a.docx", t=late) is None
    assert one(spark, text.filing_number(F.col("n"), F.col("t")), n="a.docx", t="\n".join(["x"] * 49 + ["RADICADO#-1234567"])) == "1234567"
    assert one(spark, text.filing_number(F.col("n"), F.col("t")), n="r_654321.docx", t="Radicado: 111111") == "654321"


@pytest.mark.parametrize("given,want", [("5/3/24", ("5", "MARZO", "2024")), ("31/02/2024", ("31", "FEBRERO", "2024")), ("05-13-2024", None), ("", None)])
def test_resolution_day(spark, given, want):
    got = one(spark, dates.resolution_day(F.col("c")), c=given)
    assert (tuple(got) if got else None) == want


def test_report_quirks(spark):
    page = "NOMBRE DE LA INSTITUCIÓN\n---\nClínica\nTIPO DE EQUIPOS: rx\nFecha de la visita: 01/02/2024 - Tipo de equipo evaluado: arco en c"
    rows = spark.createDataFrame([("/a/12_x.pdf", page), ("/a/b.pdf", None), ("/a/c.pdf", " \n")], "path string, text string")
    got = {r["path"]: r for r in quality.read_reports(rows).collect()}
    first = got["/a/12_x.pdf"]
    assert (first["identifier"], first["fecha_evaluacion"], first["tipo_equipo"], first["nombre_institucion"]) == ("12", "01/02/2024", "ARCO EN C", "CLÍNICA")
    assert got["/a/b.pdf"]["warnings"] == [quality.UNREADABLE] and got["/a/c.pdf"]["warnings"] == [quality.NO_TEXT]


@pytest.mark.parametrize("raw,want", [
    ('{"a":"1"}', "1"), ('```json\n{"a":"2"}\n```', "2"), ("x {“a”:“3”,} y }", "3"), ('{"a":"4","EQUIPOS":[{},]} {"a":"9"}', "4"), ("[1]", None), ("", None), ("{'a':1}", None),
])
def test_loose_json(spark, raw, want):
    row = extraction.parse_replies(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row["licence"] or {}).get("a") == want
    assert (row["reason"] is None) == (want is not None)


def test_section_dictionary_first(spark):
    assert one(spark, field_of(F.col("l"), F.col("s")), l="CATEGORIA", s="EQUIPOS A LICENCIAR") == "CATEGORIA_EQUIPO"
    assert one(spark, field_of(F.col("l"), F.col("s")), l="CATEGORIA", s=None) == "CATEGORIA"
    assert one(spark, field_of(F.col("l"), F.col("s")), l="FECHA", s="CONTROL DE CALIDAD") == "FECHA_QC"


def test_repeated_fields_start_new_equipment(spark):
    rows = [["EQUIPOS A LICENCIAR"], ["TIPO DE EQUIPO", "a"], ["SERIE", "1"], ["SERIE", "2"], ["TIPO DE EQUIPO", "b"], ["RADICADO EQUIPO 2", "7"], ["EQUIPO 3"], ["MARCA: x"]]
    frame = spark.createDataFrame([("d", 0, i, r) for i, r in enumerate(rows)], "doc_id string, table_no int, row_no int, cells array<string>")
    got = checklist.equipment_table(checklist.read_entries(frame)).orderBy("equipment_no").select("TIPO_DE_EQUIPO", "SERIE", "MARCA").collect()
    assert [tuple(r) for r in got] == [("A", "1", ""), ("B", "2", ""), ("", "", "X")]


def test_markers(spark):
    templates = spark.createDataFrame([("p", "c", 0, "A {{ x y }}{{otro}} {{FECHA_HOY}}")], "persona string, category string, paragraph_no int, text string")
    frame = licences.tokenised(templates).withColumn("data", F.create_map(F.lit("X_Y"), F.lit(" uno "), F.lit("FECHA_HOY"), F.lit("1-2-3")))
    frame = frame.withColumn("none", F.lit(None).cast(licences.FRAGMENTS))
    got = frame.select(licences.substituted(F.col("tokens"), F.col("data"), F.col("none")).alias("f")).first()["f"]
    assert [(g["text"], g["bold"]) for g in got] == [("A ", False), ("UNO", True), ("{{otro}}", False), (" ", False), ("1-2-3", False)]


@pytest.mark.parametrize("parts", [1, 5])
def test_rank_does_not_depend_on_partitions(spark, parts):
    frame = spark.range(60).select(F.lit("hot").alias("k"), ((F.col("id") * 37) % 60).alias("v")).repartition(parts)
    ranked = {r["v"]: r["n"] for r in with_rank(frame, ["k", "v"], "n").collect()}
    assert ranked == {v: v + 1 for v in range(60)}
    assert with_rank(frame.limit(0), ["k", "v"], "n").isEmpty()


def test_first_readable_reply_wins(spark):
    replies = {"late": ["{broken", '{"MARCA": "A",}', "unused"], "never": ["{a", "no", "{c"], "mute": ["", "", ""]}
    docs = spark.createDataFrame([(k, i, k) for i, k in enumerate(replies)], "file_id string, size long, text string")
    found = extraction.parse_replies(extraction.extract_replies(docs, lambda text, attempt: replies[text][attempt])).collect()
    got = {r["file_id"]: (r["size"], r["raw"], r["licence"], r["extract_error"], r["reason"]) for r in found}
    assert got["late"] == (0, '{"MARCA": "A",}', {"MARCA": "A"}, None, None)
    assert got["never"] == (1, "{c", None, None, "reply is not JSON")
    assert got["mute"] == (2, None, None, "no reply", "empty reply")


def test_numbers_of_documents_and_equipment(spark):
    docs = spark.createDataFrame([("a", ""), ("b", "7"), ("c", None), ("d", "9"), ("e", "5")], "doc_id string, RADICADO string").withColumn("CATEGORIA", F.lit("CATEGORIA 1"))
    rows = [("a", 1, "1"), ("a", 2, ""), ("b", 1, "8"), ("b", 2, " "), ("c", 1, None), ("c", 2, "4"), ("e", 1, "6")]
    equipment = spark.createDataFrame([(*r, "X") for r in rows], "doc_id string, equipment_no int, RADICADO_EQUIPO string, MARCA string")
    heads = licences.licence_heads(licences.grouped_equipment(docs, equipment)).collect()
    got = sorted((r["doc_id"], r["licence_number"], r["n_equipment"], r["split"]) for r in heads)
    assert got == [("a", "1", 2, False), ("b", "7", 1, True), ("b", "8", 1, True), ("d", "9", 1, False), ("e", "5", 1, False)]
    assert [tuple(r) for r in licences.unnumbered_documents(docs, equipment).collect()] == [("c", 2, "filing number missing")]


def test_house_style_knows_the_quality_bodies(spark):
    ruled = extraction.house_style(F.create_map(F.lit("CONTROL CALIDAD"), F.col("c")))["CONTROL CALIDAD"]
    assert [one(spark, ruled, c=v) for v in (" UNAL ", "Radioprotección e Ingeniería SAS", "Otro", None)] == [" UNAL ", "REI", "REVISAR", "REVISAR"]


def test_cells_read_alike_with_and_without_accents(spark):
    c = F.col("c")
    assert [one(spark, text.strip_accents(c), c=v) for v in ("MARCA", "Año", "é", "日本", "", None)] == ["MARCA", "Ano", "e", "日本", "", None]
    assert [one(spark, checklist.equipment_number(c), c=v) for v in ("Equipo No. 3", "equipo", "", "EQUIPO 99999999999", None)] == [3, None, None, None, None]
    pair = checklist.inline_pair(c)
    assert [one(spark, pair["value"], c=v) for v in ("MARCA: x", "Otra\nuna \n dos", "una dos", "sin corte", "\n sola \n")] == ["x", "una dos", "dos", None, None]
    cells = F.array(F.lit("*"), F.lit("Équipo_2"), c)
    heading = spark.createDataFrame([("nota",), ("",)], "c string").select(F.lit(1).alias("doc_id"), F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), cells.alias("cells"))
    assert [r["heading"] for r in checklist.read_rows(heading).collect()] == [True, True]


def test_dates_of_another_form_are_not_cast(spark):
    plan = spark.createDataFrame([("x",)], "c string").select(dates.resolution_day(F.col("c")).alias("d"))
    assert plan.collect()[0]["d"] is None
    assert one(spark, dates.resolution_day(F.col("c"))["month"], c="1/99/2024") is None
