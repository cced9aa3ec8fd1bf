"""What jobs leave on disk while they run: shuffle files and tables between steps."""

import os
import re
import uuid

from pyspark.sql import functions as F

from fichero.operators.blocks import Layout
from fichero.operators.upsert import judged, upsert
from fichero.session import Stages, shared_folder, staged

HEADERS = ["RADICADO", "ARCHIVO", "ITEM", "TIPO DE EQUIPO", "MARCA", "MODELO", "SERIE", "SERIE TUBO RX", "SEDE", "ETIQUETA IA", "Última actualización"]
LAYOUT = Layout(HEADERS)


def local(path):
    return path.removeprefix("file:").replace("//", "/")


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def tables(spark):
    """Tables in the shared folder, by folder and name."""
    root = local(shared_folder(spark))
    return {os.path.relpath(d, root) for d, _, files in os.walk(root) if "_SUCCESS" in files}


def given(spark):
    """Rows of numbers with one row, with rows of their own, with new rows and with rows that fold."""
    pieces = [("a", 1, "S1"), ("b", 1, "S1"), ("b", 2, "S2"), ("c", 1, "S1"), ("c", 2, "S1"), ("d", 1, "S1"), ("d", 2, "S2")]
    rows = spark.createDataFrame(
        [(f"{n}{i}", n, "f", "f", i, {"SERIE": s, "SERIE TUBO RX": "T", "NOTA": "n"}) for n, i, s in pieces],
        "incoming_id string, radicado string, file_id string, file_name string, item int, fields map<string,string>",
    )
    master = [(i + 1, n, "f", "1", "", "", "", s, "T", "", "", "") for i, (n, s) in enumerate([("d", "S1"), ("d", "S2"), ("e", "S1")])]
    return rows, spark.createDataFrame(master, "row_num long, " + ", ".join(f"`{h}` string" for h in HEADERS))


def test_shuffle_files_of_a_step_go_with_it(spark):
    before = shuffle_files(spark)
    key = (F.col("id") % 7).alias("k")
    table = staged(spark.range(5000).repartition(3, "id").groupBy(key).agg(F.count("*").alias("n")), "counts")
    assert not shuffle_files(spark) - before
    assert sorted(r["n"] for r in table.collect()) == [714] * 5 + [715] * 2


def test_cleared_stages_are_gone(spark):
    stages = Stages(spark)
    assert stages.staged(spark.range(3), "a").count() == 3 and stages.staged(spark.range(4), "a").count() == 4
    assert len([t for t in tables(spark) if t.startswith(os.path.basename(stages.folder))]) == 2
    stages.clear()
    assert not os.path.exists(local(stages.folder))


def test_upsert_leaves_only_what_its_results_read(spark):
    rows, master = given(spark)
    before = tables(spark)
    merged, audit = upsert(rows, master, LAYOUT, "2024-06-30T00:00:00Z")
    left = {t.rsplit("/", 1)[1] for t in tables(spark) - before}
    assert left <= {"outcomes", "numbers", "ranged"}
    assert audit.count() == 7 and merged.count() == 3 + 1 + 2 + 1


def test_rows_are_placed_without_their_fields(spark):
    """Maps and cells of all rows are the most of what an upsert could move."""
    rows, master = given(spark)
    written = []

    def write(df, name):
        written.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, f"{name}-{uuid.uuid4().hex}")

    placed = judged(rows.withColumn("_row", F.monotonically_increasing_id()), master, LAYOUT, ["_row"], write)
    assert placed.columns == ["_row", "target", "settled"]
    plan = dict(written)["matched"]
    assert "Exchange" in plan and not re.search(r"Exchange[^\n]*\n[^\n]*Project \[[^\n]*\bfields#\d+[,\]]", plan)
    assert "map_from_arrays" not in plan
