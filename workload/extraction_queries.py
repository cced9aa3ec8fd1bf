"""Replies, licences and equipment rows; one licence file holds up to about 64 order lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fichero.functions.text import blank
from fichero.plans import extraction as x
from fichero.session import shared_folder
from fichero.sources import cache
from fichero.streaming import dead_letters as dead
from fichero.streaming.arrivals import run_available
from workload.inputs import EQUIPMENT_SQL, HEADERS_SQL, equipment, headers, table

# Fields of a piece of equipment in replies, and the input column each is made of.
REPLY_FIELDS = {"TIPO DE EQUIPO": "TIPO_DE_EQUIPO", "MARCA": "MARCA", "MODELO": "MODELO", "SERIE": "SERIE", "FECHA CC": "FECHA_QC"}


def licence_files(spark, d):
    """One row per licence file with its equipment as an array of maps."""
    return (
        equipment(spark, d)
        .groupBy("l_orderkey", "file_no")
        .agg(
            F.first("file_id").alias("file_id"), F.first("file_name").alias("file_name"), F.first("radicado").alias("radicado"),
            F.first("o_orderpriority").alias("prio"), F.first("o_orderstatus").alias("status"), F.first("FECHA_FABRICACION").alias("fecha"),
            F.array_sort(F.collect_list(F.struct("item", *REPLY_FIELDS.values()))).alias("items"),
        )
        .withColumn(
            "EQUIPOS",
            F.transform("items", lambda i: F.create_map(*[p for key, column in REPLY_FIELDS.items() for p in (F.lit(key), i[column])])),
        )
        .drop("items", "l_orderkey", "file_no")
    )


def replies(spark, d):
    """Raw reply per licence file; its flaw depends on the priority and status of the order."""
    prio, status = F.col("prio"), F.col("status")
    listed = F.to_json(F.struct(F.col("fecha").alias("FECHA"), F.lit(" A@B.CO ").alias("CORREO ELECTRÓNICO"), F.lit("x").alias("CATEGORIA"), F.lit("cab").alias("MARCA"), "EQUIPOS"))
    flat = F.to_json(F.map_concat(F.create_map(F.lit("FECHA"), F.col("fecha"), F.lit("RADICADO"), F.lit(" ")), F.col("EQUIPOS")[0]))
    empty = F.to_json(F.struct(F.concat(F.lit("7"), F.col("radicado")).alias("Radicado"), F.col("fecha").alias("FECHA"), F.lit("sola").alias("MARCA"), F.array().cast("array<string>").alias("EQUIPOS")))
    raw = (
        F.when(prio == "1-URGENT", listed)
        .when(prio == "2-HIGH", F.concat(F.lit("Aquí está:\n```json\n"), listed, F.lit("\n```\nfin {")))
        .when(prio == "3-MEDIUM", F.concat(F.lit("Respuesta: "), F.regexp_replace(listed, '"([^"]*)"', "“$1”"), F.lit(" Saludos {}")))
        .when(prio == "4-NOT SPECIFIED", F.concat(F.lit("ok "), F.regexp_replace(F.regexp_replace(listed, r"\]\}$", ",]}"), r'"\}', '" , }')))
        .when(status == "F", flat).when(status == "P", empty)
        .otherwise(F.concat(F.lit('{"FECHA": "x", "EQUIPOS": [{'), F.col("radicado")))
    )
    return licence_files(spark, d).select("file_id", "file_name", "radicado", "prio", "status", raw.alias("raw"))


def parsed(spark, d):
    return x.parse_replies(replies(spark, d))


def parsed_replies(spark, d):
    return parsed(spark, d).select(
        "file_id", F.col("licence")["FECHA"].alias("fecha"), F.size("licence").cast("long").alias("n_fields"),
        F.coalesce(F.size(F.from_json(F.col("licence")["EQUIPOS"], x.EQUIPMENT_LIST)), F.lit(0)).cast("long").alias("n_listed"),
    ).filter("fecha IS NOT NULL")


def failed_documents(spark, d):
    return parsed(spark, d).filter(F.col("reason").isNotNull()).select("file_id", "reason")


def equipment_lists(spark, d):
    return (
        parsed(spark, d).filter("licence IS NOT NULL")
        .select("file_id", F.posexplode(x.equipment_list(F.col("licence"))).alias("pos", "own"))
        .select("file_id", F.col("pos").cast("long").alias("pos"), F.col("own")["MARCA"].alias("marca"), F.col("own")["SERIE"].alias("serie"))
    )


def number_fixups(spark, d):
    return parsed(spark, d).filter("licence IS NOT NULL").select(
        "file_id", x.with_number(F.col("licence"), F.col("radicado"))["RADICADO"].alias("radicado")
    )


def licence_rows(spark, d):
    f = F.col("fields")
    rows = x.licence_rows(parsed(spark, d).filter("licence IS NOT NULL"))
    return rows.select(
        "file_id", F.col("item").cast("long").alias("item"), f["ITEM"].alias("item_text"), f["ARCHIVO"].alias("archivo"),
        f["MARCA"].alias("marca"), f["FECHA"].alias("fecha"), f["CORREO ELECTRÓNICO"].alias("correo"), f["RADICADO"].alias("radicado"),
    )


def field_names(spark, d):
    rows = x.licence_rows(parsed(spark, d).filter("licence IS NOT NULL"))
    named = F.map_concat("fields", F.create_map(F.lit("DIRECCION"), F.col("file_id"), F.lit("CATEGORIA"), F.lit("y")))
    return rows.select("file_id", "item", x.renamed_fields(F.map_concat(named, F.create_map(F.lit("CATEGORÍA"), F.lit("z")))).alias("f"))


def renamed_fields(spark, d):
    f = F.col("f")
    return field_names(spark, d).select(
        "file_id", F.col("item").cast("long").alias("item"), f["DIRECCIÓN"].alias("direccion"), f["CATEGORÍA"].alias("categoria"),
        F.map_contains_key(f, "DIRECCION").cast("string").alias("has_old_name"), f["MARCA"].alias("marca"),
    )


def split_fields(spark, d):
    heads = ["MARCA", "MODELO", "FECHA", "ITEM"]
    f = F.col("f")
    return field_names(spark, d).select(
        "file_id", F.col("item").cast("long").alias("item"),
        F.array_join(F.array_sort(F.map_keys(x.known_fields(f, heads))), ",").alias("known"),
        F.array_join(F.array_sort(F.map_keys(x.unknown_fields(f, heads))), ",").alias("unknown"),
    )


def licence_texts(spark, d):
    """Licence text per file, for the rule-based extractor."""
    blocks = F.transform(
        "EQUIPOS",
        lambda e, i: F.concat(F.lit("EQUIPO "), i + 1, F.lit("\n"), F.array_join(F.transform(F.map_entries(e), lambda kv: F.concat(kv["key"], F.lit(": "), kv["value"])), "\n")),
    )
    return licence_files(spark, d).select(
        "file_id", F.col("file_name").alias("name"), "file_name", "radicado", "prio",
        F.concat(F.lit("LICENCIA\nFECHA: "), F.col("fecha"), F.lit("\n"), F.array_join(blocks, "\n")).alias("text"),
    )


def extracted_licences(spark, d):
    texts = licence_texts(spark, d)
    done = x.parse_replies(x.extract_replies(texts)).select("file_id", "file_name", "radicado", "licence")
    f = F.col("fields")
    return x.licence_rows(done).select(
        "file_id", F.col("item").cast("long").alias("item"), f["MARCA"].alias("marca"), f["MODELO"].alias("modelo"), f["FECHA CC"].alias("fecha_cc"), f["FECHA"].alias("fecha")
    )


def extraction_cache(spark, d):
    """Extractions stored earlier, by an older run: the urgent and high-priority files."""
    return x.cache_entries(parsed(spark, d).filter("prio IN ('1-URGENT', '2-HIGH')"), F.lit("2024-01-01T00:00:00Z"))


def cached_or_extracted(spark, d):
    return _looked_up(x.cached_or_extracted(licence_texts(spark, d), extraction_cache(spark, d)))


def _looked_up(done):
    return done.select("file_id", F.col("from_cache").cast("string").alias("from_cache"), F.col("licence")["FECHA"].alias("fecha"), F.col("licence")["MARCA"].alias("marca"))


def cache_snapshot(spark, d):
    new = x.cache_entries(parsed(spark, d).filter("prio IN ('2-HIGH', '3-MEDIUM')"), F.lit("2024-06-30T00:00:00Z"))
    return _snapshot(x.newest_cache(extraction_cache(spark, d), new))


def _snapshot(entries):
    return entries.select(
        "cache_key", "stored_at", F.col("licence")["RADICADO"].alias("radicado"),
        F.size(F.from_json(F.col("licence")["EQUIPOS"], x.EQUIPMENT_LIST)).cast("long").alias("n_equipment"),
    )


def _stored_cache(spark, d):
    store = cache.extraction_cache(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}")
    return cache.start_cache(store, extraction_cache(spark, d))


def stored_cache(spark, d):
    """The same entries as a stored cache that a second run adds to, once though given twice."""
    store = _stored_cache(spark, d)
    new = x.cache_entries(parsed(spark, d).filter("prio IN ('2-HIGH', '3-MEDIUM')"), F.lit("2024-06-30T00:00:00Z"))
    for _ in range(2):
        cache.store_entries(store, new, 0)
    return _snapshot(store.read())


def stored_cache_lookups(spark, d):
    return _looked_up(cache.cached_or_extracted_from(_stored_cache(spark, d), licence_texts(spark, d)))


def replayed_letters(spark, d):
    """Replies as a stream: those that cannot be read wait as letters, are mended, and are replayed once."""
    folder = f"{shared_folder(spark)}/letters-{uuid.uuid4().hex}"
    replies(spark, d).select("file_id", "raw").write.parquet(f"{folder}/in")
    letters = dead.dead_letters(spark, f"{folder}/dead")
    stream = spark.readStream.schema("file_id string, raw string").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    run_available(stream, f"{folder}/state", dead.isolated(x.parse_replies, letters, f"{folder}/out"))
    mended = lambda waiting: waiting.withColumn("raw", F.concat("raw", F.lit("}]}")))
    for mend, batch in ((lambda waiting: waiting, 1_000_000), (mended, 1_000_001), (mended, 1_000_001)):
        dead.replay(letters, lambda rows: x.parse_replies(rows.withColumn("raw", F.regexp_replace("raw", r"\[\{\d+\}", "[{}"))), f"{folder}/out", batch, mend)
    done = spark.read.option("mergeSchema", "true").parquet(f"{folder}/out").groupBy("file_id").agg(F.count("*").alias("n_results"), F.max(F.col("licence")["FECHA"]).alias("fecha"))
    state = letters.read().select("file_id", F.col("attempts").cast("long").alias("attempts"), F.col("waiting").cast("string").alias("waiting"))
    return done.join(state, "file_id", "full").fillna({"attempts": 0, "waiting": "never"})


def new_documents(spark, d):
    files = licence_files(spark, d).select("file_id", "file_name", "radicado")
    return x.without_cached_file(files, extraction_cache(spark, d)).select("file_id", "radicado")


def house_style(spark, d):
    h = headers(spark, d)
    fields = F.create_map(
        F.lit("TIPO DE SOLICITUD"), F.when(F.col("o_orderstatus") == "P", "modificación opr/epr ").otherwise("Renovación"),
        F.lit("SEDE"), F.concat(F.lit("Empresa Social del Estado "), F.col("MUNICIPIO")),
        F.lit("SERIE"), F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("RESOLUCION")),
        F.lit("CONTROL CALIDAD"), F.when(F.col("o_orderpriority") == "1-URGENT", "Radioprotección e Ingeniería SAS").otherwise(F.col("NOMBRE_SOLICITANTE")),
    )
    f = F.col("f")
    return h.select("radicado", x.house_style(fields).alias("f")).select(
        "radicado", f["SEDE"].alias("sede"), f["SERIE"].alias("serie"), f["CONTROL CALIDAD"].alias("control")
    )


# --- SQL ----------------------------------------------------------------------------------

FILES_SQL = EQUIPMENT_SQL + """,
files AS (
  SELECT file_id, file_name, radicado, o_orderpriority AS prio, o_orderstatus AS status, FECHA_FABRICACION AS fecha, count(*) AS n,
    arg_min(MARCA, item) AS marca1, arg_min(SERIE, item) AS serie1 FROM equipment GROUP BY ALL
)"""
_BROKEN = "prio = '5-LOW' AND status = 'O'"
_ROWS_SQL = FILES_SQL + f""",
rows AS (
  SELECT e.file_id, e.item, e.file_name, e.radicado, e.MARCA, e.SERIE, e.FECHA_FABRICACION AS fecha, e.o_orderpriority AS prio, e.o_orderstatus AS status
  FROM equipment e WHERE o_orderpriority <> '5-LOW'
  UNION ALL
  SELECT file_id, 1, file_name, CASE WHEN status = 'P' THEN '7' || radicado ELSE radicado END,
    CASE WHEN status = 'P' THEN 'sola' ELSE marca1 END, CASE WHEN status = 'F' THEN serie1 END, fecha, prio, status
  FROM files WHERE prio = '5-LOW' AND status <> 'O'
)"""
_LISTED = "prio <> '5-LOW'"

QUERIES = {
    "parsed_replies": (parsed_replies, f"""WITH {FILES_SQL} SELECT file_id, fecha,
        CAST(CASE WHEN {_LISTED} THEN 5 WHEN status = 'F' THEN 7 ELSE 4 END AS BIGINT) AS n_fields,
        CASE WHEN {_LISTED} THEN n ELSE 0 END AS n_listed FROM files WHERE NOT ({_BROKEN})"""),
    "failed_documents": (failed_documents, f"WITH {FILES_SQL} SELECT file_id, 'reply is not JSON' AS reason FROM files WHERE {_BROKEN}"),
    "equipment_lists": (equipment_lists, f"""WITH {_ROWS_SQL} SELECT file_id, CAST(item - 1 AS BIGINT) AS pos, MARCA AS marca,
        nullif(SERIE, CASE WHEN prio = '5-LOW' THEN '' END) AS serie FROM rows"""),
    "number_fixups": (number_fixups, f"""WITH {FILES_SQL} SELECT file_id, CASE WHEN prio = '5-LOW' AND status = 'P' THEN '7' || radicado ELSE radicado END AS radicado
        FROM files WHERE NOT ({_BROKEN})"""),
    "licence_rows": (licence_rows, f"""WITH {_ROWS_SQL} SELECT file_id, CAST(item AS BIGINT) AS item, CAST(item AS VARCHAR) AS item_text, file_name AS archivo,
        MARCA AS marca, fecha, CASE WHEN {_LISTED} THEN 'a@b.co' END AS correo, radicado FROM rows"""),
    "renamed_fields": (renamed_fields, f"""WITH {_ROWS_SQL} SELECT file_id, CAST(item AS BIGINT) AS item, file_id AS direccion, 'z' AS categoria,
        'false' AS has_old_name, MARCA AS marca FROM rows"""),
    "split_fields": (split_fields, f"""WITH {_ROWS_SQL} SELECT file_id, CAST(item AS BIGINT) AS item,
        CASE WHEN {_LISTED} OR status = 'F' THEN 'FECHA,ITEM,MARCA,MODELO' ELSE 'FECHA,ITEM,MARCA' END AS known,
        CASE WHEN {_LISTED} THEN 'ARCHIVO,CATEGORÍA,CORREO ELECTRÓNICO,DIRECCIÓN,FECHA CC,RADICADO,SERIE,TIPO DE EQUIPO'
             WHEN status = 'F' AND SERIE <> '' THEN 'ARCHIVO,CATEGORÍA,DIRECCIÓN,FECHA CC,RADICADO,SERIE,TIPO DE EQUIPO'
             WHEN status = 'F' THEN 'ARCHIVO,CATEGORÍA,DIRECCIÓN,FECHA CC,RADICADO,SERIE,TIPO DE EQUIPO'
             ELSE 'ARCHIVO,CATEGORÍA,DIRECCIÓN,RADICADO' END AS unknown FROM rows"""),
    "extracted_licences": (extracted_licences, f"""WITH {EQUIPMENT_SQL} SELECT file_id, CAST(item AS BIGINT) AS item, MARCA AS marca, MODELO AS modelo,
        FECHA_QC AS fecha_cc, FECHA_FABRICACION AS fecha FROM equipment"""),
    "cached_or_extracted": (cached_or_extracted, f"""WITH {FILES_SQL} SELECT file_id, CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN 'true' ELSE 'false' END AS from_cache,
        fecha, CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN 'cab' END AS marca FROM files"""),
    "cache_snapshot": (cache_snapshot, f"""WITH {FILES_SQL} SELECT radicado || '__' || file_id AS cache_key,
        CASE WHEN min(prio) = '1-URGENT' THEN '2024-01-01T00:00:00Z' ELSE '2024-06-30T00:00:00Z' END AS stored_at, radicado, max(n) AS n_equipment
        FROM files WHERE prio IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY radicado, file_id"""),
    "replayed_letters": (replayed_letters, f"""WITH {FILES_SQL} SELECT file_id, CAST(1 AS BIGINT) AS n_results, CASE WHEN {_BROKEN} THEN 'x' ELSE fecha END AS fecha,
        CAST(CASE WHEN {_BROKEN} THEN 3 ELSE 0 END AS BIGINT) AS attempts, CASE WHEN {_BROKEN} THEN 'false' ELSE 'never' END AS waiting FROM files"""),
    "new_documents": (new_documents, f"WITH {FILES_SQL} SELECT file_id, radicado FROM files WHERE prio NOT IN ('1-URGENT', '2-HIGH')"),
    "house_style": (house_style, f"""WITH {HEADERS_SQL} SELECT radicado, 'ESE ' || n_name AS sede,
        CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 'NO REGISTRA' ELSE RESOLUCION END AS serie,
        CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'REI' ELSE 'REVISAR' END AS control FROM headers"""),
}
QUERIES["stored_cache"] = (stored_cache, QUERIES["cache_snapshot"][1])
QUERIES["stored_cache_lookups"] = (stored_cache_lookups, QUERIES["cached_or_extracted"][1])
