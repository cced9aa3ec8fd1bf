"""Stored cache, files as results, dead letters, run ledger, pages of reports and gap patterns on small tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fichero.functions.text import file_name
from fichero.operators.blocks import Layout, first_incomplete_rows, gap_index
from fichero.operators.ledger import RunLedger
from fichero.plans import quality
from fichero.session import staged
from fichero.sources import cache, docx, files
from fichero.streaming import dead_letters as dead


def test_cache_keeps_the_newest_entry_and_extracts_only_misses(spark, tmp_path):
    store = cache.start_cache(cache.extraction_cache(spark, str(tmp_path / "c"), buckets=8))
    first = spark.createDataFrame([("1__a", {"FECHA": "old"}, "2024-01-01"), ("1__a", {"FECHA": "new"}, "2024-01-02"), ("2__b", {"FECHA": "b"}, "2024-01-01")], cache.ENTRY)
    assert cache.store_entries(store, first, 0) and not cache.store_entries(store, first, 0)
    assert cache.store_entries(store, spark.createDataFrame([("2__b", {"FECHA": "b2"}, "2024-02-01")], cache.ENTRY), 1)
    assert {r["cache_key"]: r["licence"]["FECHA"] for r in store.read().collect()} == {"1__a": "new", "2__b": "b2"}
    documents = spark.createDataFrame([("1", "a", "a.docx", "x"), ("9", "z", "z.docx", "x")], "radicado string, file_id string, name string, text string")
    got = cache.cached_or_extracted_from(store, documents, lambda text, attempt: '{"FECHA": "fresh", "EQUIPOS": [{}]}').collect()
    assert {(r["file_id"], r["from_cache"], r["licence"]["FECHA"]) for r in got} == {("a", True, "new"), ("z", False, "fresh")}


def rendered(spark, rows):
    fragments = "array<struct<text:string,bold:boolean>>"
    return spark.createDataFrame(rows, f"doc_id string, licence_number string, output_name string, paragraph_no int, block_no int, fragments {fragments}")


def test_licences_are_one_file_each_and_read_back(spark, tmp_path):
    paragraphs = rendered(spark, [
        ("d1", "7", "7_LICENCIA", 1, 0, [("segundo <&>", True), (" más", False)]), ("d1", "7", "7_LICENCIA", 0, 0, [("primero", False)]),
        ("d1", "7", "7_LICENCIA", 1, 5, []), ("d2", "7", "7_LICENCIA", 0, 0, [("otro\x01", False)]), ("d3", "8", "a/b", 0, 0, [(None, False)]),
    ])
    pattern = files.write_licences(paragraphs.repartition(3), str(tmp_path / "out"))
    read = docx.read_documents(docx.files(spark, pattern)).select(file_name(F.col("path")).alias("name"), "text", "reason").collect()
    assert {r["name"]: (r["text"], r["reason"]) for r in read} == {"7_LICENCIA.docx": ("primero\nsegundo <&> más\n", None), "7_LICENCIA_2.docx": ("otro", None), "a_b.docx": ("", None)}


def test_a_failed_job_leaves_no_visible_file(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") < 39, F.lit("x").cast("binary")).otherwise(F.expr("CAST(raise_error('broken') AS BINARY)")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(rows, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("files-*"))
    assert not [p for p in (tmp_path / "out").rglob("f*") if not p.parent.name.startswith("_attempt-")]
    files.write_files(rows.where("name <> 'f39'"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("files-*/f*"))) == 39 and not list((tmp_path / "out").glob("_job-*"))


def test_written_files_are_read_by_folders_not_one_by_one(spark, tmp_path):
    rows = spark.range(9000).repartition(2).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    files.write_files(rows, str(tmp_path / "out"))
    read = files.read_files(spark, str(tmp_path / "out"))
    assert read.rdd.getNumPartitions() <= 4  # a scan of the files would deal out 32 or so a task
    assert {(r["name"], bytes(r["content"])) for r in read.collect()} == {(f"f{i}", str(i).encode()) for i in range(9000)}
    assert all(len(list(p.iterdir())) <= files.FOLDER for p in (tmp_path / "out").iterdir())


def test_a_name_that_repeats_in_a_task_is_no_lost_file(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", b"x"), ("a_b", b"y")], "name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="a_b"):
        files.write_files(rows, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("files-*"))


def test_a_task_that_ends_after_its_job_was_given_up_shows_nothing(tmp_path, monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 0)
        taskAttemptId = staticmethod(lambda: 7)

    monkeypatch.setattr(files.TaskContext, "get", staticmethod(Task))
    writer = files._Writer(str(tmp_path / "out"))
    writer.abort([])
    writer.write(iter([pa.RecordBatch.from_pydict({"name": ["a"], "content": [b"x"]})]))
    assert {p.name.split("-")[0] for p in (tmp_path / "out").iterdir()} == {"_attempt"}
    writer.abort([])
    assert not list((tmp_path / "out").iterdir())


def test_report_export_round_trip(spark, tmp_path):
    reports = spark.createDataFrame([("/q/1_a.pdf", "1", "f", "", "ñ", ["w"])], "path string, identifier string, fecha_evaluacion string, tipo_equipo string, nombre_institucion string, warnings array<string>")
    files.write_reports(quality.export_rows(reports), str(tmp_path / "json"))
    assert [tuple(r) for r in files.read_report_export(spark, str(tmp_path / "json")).collect()] == [("1_a.pdf", "/q/1_a.pdf", "1", "f", "", "ñ")]


def test_letters_wait_until_they_are_mended_or_given_up(spark, tmp_path):
    def parse(rows):
        return rows.withColumn("reason", F.when(F.col("raw") == "bad", "no good"))

    def state():
        return {r["file_id"]: (r["attempts"], r["waiting"]) for r in letters.read().collect()}

    letters, out = dead.dead_letters(spark, str(tmp_path / "dead"), buckets=4), str(tmp_path / "out")
    handle = dead.isolated(parse, letters, out)
    batch = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "bad")], "file_id string, raw string")
    handle(batch, 0)
    handle(batch, 0)  # given again
    assert state() == {"b": (1, True), "c": (1, True)} and spark.read.parquet(out).count() == 1
    mend = lambda waiting: waiting.withColumn("raw", F.when(F.col("file_id") == "b", "good").otherwise(F.col("raw")))
    assert dead.replay(letters, parse, out, 100, mend, most=2) and not dead.replay(letters, parse, out, 100, mend, most=2)
    assert state() == {"b": (2, False), "c": (2, True)}
    assert dead.replay(letters, parse, out, 101, most=2) and state() == {"b": (2, False), "c": (2, True)}
    assert sorted(r["file_id"] for r in spark.read.option("mergeSchema", "true").parquet(out).collect()) == ["a", "b"]


def test_ledger_counts_what_is_written(spark):
    ledger = RunLedger()
    staged(ledger.watch(spark.range(100), "numbers", all=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0)), "n")
    staged(ledger.watch(spark.range(0), "nothing", all=F.count(F.lit(1)), largest=F.max("id")), "n")
    assert sorted(map(tuple, ledger.rows(spark).collect())) == [("nothing", "all", 0), ("nothing", "largest", 0), ("numbers", "all", 100), ("numbers", "even", 50)]


def test_pages_of_a_report(spark):
    pages = spark.createDataFrame([("a", 2, "dos"), ("a", 1, "uno"), ("a", 10, "diez"), ("b", 1, None), ("c", 1, None), ("c", 2, "x")], "path string, page_no int, text string")
    read = lambda last: {r["path"]: r["text"] for r in quality.report_pages(pages, last).collect()}
    assert read(None) == {"a": "uno\ndos\ndiez", "b": None, "c": "x"}
    assert read(2) == {"a": "uno\ndos", "b": None, "c": "x"} and read(1) == {"a": "uno", "b": None, "c": None}


def test_gap_patterns_of_a_wide_table(spark):
    """More columns than one mask holds; a number of many rows has as many index rows as patterns."""
    headers = ["RADICADO", "SERIE"] + [f"C{i}" for i in range(70)]
    layout = Layout(headers)
    gaps = {3: ["C0", "C65"], 5: ["C1", "C64", "C69"], 7: ["SERIE"]}
    rows = [(n, *["7" if h == "RADICADO" else "" if h in gaps.get(n, []) else "x" for h in headers]) for n in range(2, 200)]
    master = spark.createDataFrame(rows, "row_num long, " + ", ".join(f"{h} string" for h in headers))
    assert gap_index(master, layout).count() == 4
    fields = {"i": ["C0", "C1", "C64", "C65", "C69"], "j": ["C1", "C64", "C69"], "k": ["C0", "C65", "C2", "C3"]}
    incoming = spark.createDataFrame([(i, "7", {c: "v" for c in named}) for i, named in fields.items()] + [("z", "8", {"C0": "v"})], "incoming_id string, radicado string, fields map<string,string>")
    got = {r["incoming_id"]: (r["no_serial_row"], r["gappy_row"]) for r in first_incomplete_rows(incoming, master, layout).collect()}
    assert got == {"i": (7, 5), "j": (7, None), "k": (7, None)}
