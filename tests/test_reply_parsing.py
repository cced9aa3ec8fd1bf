"""A reply, and the equipment list in it, is parsed once."""

from pyspark.sql import functions as F

from fichero.plans import extraction as x

REPLIES = {
    "a": ('{"FECHA": "1", "EQUIPOS": [{"MARCA": "m"}]}', "1", ["m"]),
    "b": ("Aquí:\n```JSON\n{“FECHA”: “2”, “EQUIPOS”: []}\n```\nfin {", "2", [None]),
    "c": ("``` no fence {\"FECHA\": \"3\", \"MARCA\": \"f\",} {", "3", ["f"]),
    "d": ('{"FECHA": "4", "EQUIPOS": null, "MARCA": "g"}', "4", ["g"]),
    "e": (" {\"FECHA\": \"5\", \"EQUIPOS\": \"x\", \"MODELO\": \"o\"} ", "5", [None]),
    "f": ('{"FECHA": "6"', None, None),
    "g": (" ", None, None),
    "h": (None, None, None),
}


def parsed(spark):
    return x.parse_replies(spark.createDataFrame([(k, v[0]) for k, v in REPLIES.items()], "k string, raw string"))


def test_replies_read_the_same(spark):
    rows = parsed(spark).select("k", F.col("licence")["FECHA"].alias("f"), F.when(F.col("licence").isNotNull(), F.transform(x.equipment_list(F.col("licence")), lambda e: e["MARCA"])).alias("m"), "reason").collect()
    assert {r["k"]: (r["f"], r["m"]) for r in rows} == {k: v[1:] for k, v in REPLIES.items()}
    assert {r["k"]: r["reason"] for r in rows if r["reason"]} == {"f": "reply is not JSON", "g": "empty reply", "h": "empty reply"}


def test_nothing_is_parsed_twice(spark):
    plan = parsed(spark).select("licence")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 3  # the whole text, its block, the block without trailing commas
    maps = spark.createDataFrame([({"EQUIPOS": "[]"},)], "licence map<string,string>")
    listed = maps.select(F.explode(x.equipment_list(F.col("licence"))))._jdf.queryExecution().analyzed().toString()
    assert listed.count("from_json") == 1
