"""Report lines are cut and labels found by the cheapest rule that gives the same answer as the general one."""

import pytest
from pyspark.sql import functions as F

from fichero.functions.text import LINE_BREAK, lines
from fichero.plans import quality


TEXTS = [
    "Fecha de visita: 1\nTIPO DE EQUIPO | x", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k\n", "\n\n", "", "\r", "sola", "á\n–\n\x85",
]
LINES = [
    "FECHA DE LA VISITA: 1 TIPO DE EQUIPO EVALUADO | x", "Nombre de la Institución – y .", "nómbre instituciön z", "tipo equipo", "XFECHA VISITA: 1", "FECHA VISITAÑ 1",
    "ªFECHA VISITA: 1", "²FECHA VISITA: 1", "µ tipo equipo: 5 equipo evaluado 6", "FECHA VISITA: a\u0002b TIPO EQUIPO: c", "FECHA\u0001 VISITA: 1", "Fecha visita: – TIPO EQUIPO — fin", "Nombre institución: w",
]


def test_lines_are_those_of_the_general_rule(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    for limit in (-1, 2):
        assert df.filter(~lines(F.col("t"), limit).eqNullSafe(F.split("t", LINE_BREAK, limit))).count() == 0


@pytest.mark.parametrize("regex", ["_WESTERN_REGEX", "_LABEL_REGEX"])
def test_pairs_of_latin_lines_are_those_of_the_wider_rules(spark, regex):
    df = spark.createDataFrame([(t,) for t in LINES], "t string")
    line = F.col("t")
    latin = df.filter(~line.rlike(quality._BEYOND_LATIN) & ~line.contains("\u0001") & ~line.contains("\u0002"))
    assert latin.count() == 10
    wider = quality._pairs_by(line, getattr(quality, regex))
    assert latin.filter(~quality._latin_pairs(line).eqNullSafe(wider)).collect() == []
    assert df.filter(~quality.line_pairs(line).eqNullSafe(quality._pairs_by(line, quality._LABEL_REGEX))).collect() == []
