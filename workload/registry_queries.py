"""Master table lookups and upserts. The registry holds the equipment of finished orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fichero.functions.text import placeholder_empty
from fichero.operators import blocks, upsert as up
from fichero.session import shared_folder, staged
from fichero.streaming import arrivals
from workload.inputs import EQUIPMENT_SQL, LINES_SQL, equipment, filing_number_of, lines, table

HEADERS = [
    "RADICADO", "ARCHIVO", "ITEM", "TIPO DE EQUIPO", "MARCA", "MODELO", "SERIE", "SERIE TUBO RX", "SEDE", "ETIQUETA IA", "Última actualización",
]
LAYOUT = blocks.Layout(HEADERS)
STAMP = "2024-06-30T00:00:00Z"
# Rows of one order lie together, with free rows between the blocks.
ROW_NUM = "l_orderkey * 4294967296 + file_no * 1000000 + item"


def stored(df):
    """Derived inputs stand for stored tables, which an upsert reads several times."""
    return staged(df, "input")


def sheet(spark, d):
    """Raw sheet rows of finished orders: trailing blank cells are missing, line 7 of returned goods is empty."""
    e = equipment(spark, d).filter("o_orderstatus = 'F'")
    cells = F.array(
        "radicado", "file_name", F.col("item").cast("string"), "TIPO_DE_EQUIPO", "MARCA", "MODELO",
        F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("own_serial")),
        F.when(F.col("l_returnflag") == "R", "no registra").otherwise("T1"),
        F.when(F.col("l_returnflag") == "N", "centro").otherwise(" "),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), "antes").otherwise(""), F.lit(""),
    )
    empty = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    last = F.when(F.col("l_returnflag") != "N", 8).when(F.col("l_linenumber") == 1, 10).otherwise(9)
    return e.select(F.expr(ROW_NUM).alias("row_num"), F.when(empty, F.array().cast("array<string>")).otherwise(F.slice(cells, F.lit(1), last)).alias("cells"))


def master(spark, d):
    return blocks.sheet_rows(sheet(spark, d), [f" {h} " for h in HEADERS])


SHEET_SQL = EQUIPMENT_SQL + f""",
sheet AS (
  SELECT {ROW_NUM} AS row_num, l_returnflag = 'R' AND l_linenumber = 7 AS hollow, radicado, file_id, file_name, item, TIPO_DE_EQUIPO AS tipo, MARCA AS marca, MODELO AS modelo,
    CASE WHEN l_returnflag = 'A' THEN '' ELSE own_serial END AS serie, CASE WHEN l_returnflag = 'R' THEN 'no registra' ELSE 'T1' END AS tubo,
    CASE WHEN l_returnflag = 'N' THEN 'centro' ELSE '' END AS sede, CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 'antes' ELSE '' END AS etiqueta, l_returnflag
  FROM equipment WHERE o_orderstatus = 'F'
)"""


def master_rows(spark, d):
    return master(spark, d).select(
        "row_num", *[F.col(f"`{h}`").alias(a) for h, a in zip(HEADERS, ["radicado", "archivo", "item", "tipo", "marca", "modelo", "serie", "tubo", "sede", "etiqueta", "actualizado"])]
    )


def missing_columns(spark, d):
    """Columns an ingest of orders, lines and documents asks for that the given tables do not have."""
    wanted = {"orders": ["o_orderkey", "o_orderdate", "o_radicado"], "lineitem": ["l_orderkey", "l_serie", "l_linenumber"], "documents": ["doc_id", "text", "archivo"]}
    found = [blocks.missing_columns(spark, table(spark, d, name).columns, required).select(F.lit(name).alias("name"), "missing") for name, required in wanted.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def empty_rows(spark, d):
    return master(spark, d).filter(blocks.row_is_empty(HEADERS)).select("row_num")


def placeholder_cells(spark, d):
    e = equipment(spark, d)
    return e.select(
        "file_id", F.col("item").cast("long").alias("item"),
        *[F.when(placeholder_empty(F.col(c)), 1).otherwise(0).cast("long").alias(c.lower()) for c in ("SERIE", "MARCA_TUBO", "MODELO_TUBO", "SERIE_TUBO")],
    )


def incoming(spark, d, serial="own_serial"):
    """Equipment rows of every order, as they come from the licences."""
    e = equipment(spark, d)
    fields = F.create_map(
        F.lit("RADICADO"), F.col("radicado"), F.lit("SEDE"), F.lit("sur"), F.lit("TIPO DE EQUIPO"), F.col("TIPO_DE_EQUIPO"), F.lit("MARCA"), F.col("MARCA"),
        F.lit("MODELO"), F.col("MODELO"), F.lit("SERIE"), F.col(serial), F.lit("SERIE TUBO RX"), F.lit("T2"), F.lit("NOTA"), F.lit("n"),
        F.lit("ITEM"), F.col("item").cast("string"), F.lit("ARCHIVO"), F.col("file_name"),
    )
    return e.select(
        F.concat("file_id", F.lit("/"), "item").alias("incoming_id"), "radicado", "file_id", "file_name", "item", fields.alias("fields"), "o_orderstatus"
    )


def block_rows(spark, d):
    return blocks.block_rows(incoming(spark, d), master(spark, d), LAYOUT).select("row_num", F.col("RADICADO").alias("radicado"))


def compound_matches(spark, d):
    return blocks.compound_first_match(incoming(spark, d, "SERIE"), master(spark, d), LAYOUT)


def incomplete_rows(spark, d):
    rows = blocks.first_incomplete_rows(incoming(spark, d), master(spark, d), LAYOUT)
    return rows.select("incoming_id", *[F.col(c).cast("string").alias(c) for c in ("no_serial_row", "gappy_row")])


def audited_numbers(spark, d):
    return blocks.numbers_with_value(master(spark, d), LAYOUT, LAYOUT.audit)


def block_extents(spark, d):
    return blocks.block_extents(master(spark, d).filter("RADICADO <> ''"), LAYOUT)


def free_rows(spark, d):
    return blocks.free_row_after_block(master(spark, d), LAYOUT)


# --- upsert of many rows per number -------------------------------------------------------


def registered(spark, d):
    """Master table in which every row of a finished order is found again by its key; some lack the site."""
    e = equipment(spark, d).filter("o_orderstatus = 'F'")
    return e.select(
        F.expr(ROW_NUM).alias("row_num"), F.col("radicado").alias("RADICADO"), F.col("file_name").alias("ARCHIVO"), F.col("item").cast("string").alias("ITEM"),
        F.col("TIPO_DE_EQUIPO").alias("TIPO DE EQUIPO"), "MARCA", "MODELO", F.col("own_serial").alias("SERIE"), F.lit("T1").alias("SERIE TUBO RX"),
        F.when(F.col("l_returnflag") == "N", "centro").otherwise("").alias("SEDE"), F.when(F.col("l_returnflag") == "A", "antes").otherwise("").alias("ETIQUETA IA"),
        F.lit("").alias("Última actualización"),
    )


def _merged(spark, d):
    return up.upsert(stored(incoming(spark, d)), stored(registered(spark, d)), LAYOUT, STAMP)


def merged_audit(spark, d):
    return _merged(spark, d)[1]


def upsert_audit(spark, d):
    audit = merged_audit(spark, d)
    return audit.select("incoming_id", "radicado", "action", "row", *[F.array_join(c, ",").alias(c) for c in ("filled", "skipped", "missing")])


def upsert_master(spark, d):
    return _readable(_merged(spark, d)[0])


def _readable(merged):
    return merged.select(
        "row_num", F.col("RADICADO").alias("radicado"), F.col("ITEM").alias("item"), F.col("SERIE").alias("serie"), F.col("SERIE TUBO RX").alias("tubo"), F.col("SEDE").alias("sede"),
        F.col("ETIQUETA IA").alias("etiqueta"), F.col("Última actualización").alias("actualizado"),
    )


def upsert_summary(spark, d):
    return up.run_summary(_merged(spark, d)[1])


def _stored(spark, d):
    """The same merge as the equipment comes in: two files of rows, each streamed into the stored table, and once more."""
    folder = f"{shared_folder(spark)}/master-{uuid.uuid4().hex}"
    store = arrivals.start_master(arrivals.master_store(spark, f"{folder}/master", LAYOUT), registered(spark, d), LAYOUT)
    rows = stored(incoming(spark, d).drop("o_orderstatus"))
    middle = filing_number_of(F.lit(table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] // 2))
    for early in (True, False):
        rows.where((F.col("file_name") < middle) == early).write.mode("append").parquet(f"{folder}/in")
        for _ in range(2):
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            arrivals.run_available(stream, f"{folder}/state", arrivals.upsert_batches(store, LAYOUT, lambda batch_id: STAMP))
    return store


def master_of_batches(spark, d):
    return _readable(arrivals.current_master(_stored(spark, d), LAYOUT))


def master_writes(spark, d):
    """Rows written as batches came in: the table once, then the rows of each batch."""
    log = _stored(spark, d).versions().where("kind = 'delta' OR version = 0")
    return log.groupBy("kind").agg(F.sum("rows").alias("n"))


_MERGED_SQL = EQUIPMENT_SQL + f""",
fresh AS (
  SELECT file_id, item, row_number() OVER (ORDER BY file_name, file_id, item) AS rank,
    CASE WHEN lag(radicado) OVER (ORDER BY file_name, file_id, item) = radicado THEN 'insert_at_free' ELSE 'append' END AS action
  FROM equipment WHERE o_orderstatus <> 'F'
),
top AS (SELECT max({ROW_NUM}) AS last FROM equipment WHERE o_orderstatus = 'F'),
merged AS (
  SELECT e.*, f.action AS new_action, CASE WHEN f.rank IS NULL THEN {ROW_NUM.replace('item', 'e.item')} ELSE last + f.rank END AS row_num, e.l_returnflag <> 'N' AS no_site
  FROM equipment e CROSS JOIN top LEFT JOIN fresh f ON e.file_id = f.file_id AND e.item = f.item
)"""
_OLD_SKIPS = "ARCHIVO, ITEM, MARCA, MODELO, RADICADO, SEDE, SERIE, SERIE TUBO RX, TIPO DE EQUIPO"


# --- upsert of one row per number ---------------------------------------------------------


def one_per_number(spark, d):
    """One incoming row per order."""
    o = table(spark, d, "orders")
    name = F.concat(filing_number_of(F.col("o_orderkey")), F.lit("_0.docx"))
    fields = F.create_map(
        F.lit("RADICADO"), filing_number_of(F.col("o_orderkey")), F.lit("SEDE"), F.lit("sur"), F.lit("MARCA"), F.lit(" "), F.lit("SERIE"), F.lit("NO REGISTRA"),
        F.lit("SERIE TUBO RX"), F.lit(""), F.lit("ITEM"), F.lit("1"), F.lit("ARCHIVO"), name,
    )
    return o.select(
        F.format_string("%08d", "o_orderkey").alias("incoming_id"), filing_number_of(F.col("o_orderkey")).alias("radicado"), F.format_string("%08d", "o_orderkey").alias("file_id"),
        name.alias("file_name"), F.lit(1).alias("item"), fields.alias("fields"),
    )


def priority_blocks(spark, d):
    """Blocks whose rows can be matched, reused or neither, by the priority of their order."""
    # orders grow with the lines and are never sent out whole
    o = table(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderpriority", "o_orderstatus").hint("merge")
    rows = lines(spark, d).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    prio, flag = F.col("o_orderpriority"), F.col("l_returnflag")
    number = filing_number_of(F.col("l_orderkey"))
    urgent, gaps = prio == "1-URGENT", (prio == "3-MEDIUM") & (flag == "R")
    own = rows.select(
        F.expr(ROW_NUM).alias("row_num"), number.alias("RADICADO"),
        F.when(urgent, F.concat(number, F.lit("_"), "file_no", F.lit(".docx"))).otherwise("old").alias("ARCHIVO"),
        F.when(gaps, "").otherwise(F.col("item").cast("string")).alias("ITEM"), F.lit("t").alias("TIPO DE EQUIPO"), F.when(gaps, "NO APLICA").otherwise("b").alias("MARCA"), F.lit("m").alias("MODELO"),
        F.when((prio == "2-HIGH") & (flag == "A"), "").otherwise("S").alias("SERIE"), F.lit("T").alias("SERIE TUBO RX"), F.lit("").alias("SEDE"), F.lit("").alias("ETIQUETA IA"), F.lit("").alias("Última actualización"),
    )
    last = rows.filter("o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O'").groupBy("l_orderkey").agg(F.max(F.expr(ROW_NUM)).alias("row_num"))
    strays = last.select((F.col("row_num") + 1).alias("row_num"), F.concat(F.lit("otro"), "l_orderkey").alias("RADICADO"), *[F.lit("").alias(h) for h in HEADERS[1:]])
    return own.unionByName(strays)


def placement_rules(spark, d):
    placed = up.place_single(one_per_number(spark, d), priority_blocks(spark, d), LAYOUT)
    return placed.select("incoming_id", "rule", F.col("target").cast("string").alias("target"))


def _single(spark, d):
    return up.upsert(stored(one_per_number(spark, d)), stored(priority_blocks(spark, d)), LAYOUT, STAMP)


def upsert_single_audit(spark, d):
    return _single(spark, d)[1].select("incoming_id", "action", "row", *[F.array_join(c, ",").alias(c) for c in ("filled", "skipped")])


def upsert_single_master(spark, d):
    return _single(spark, d)[0].select("row_num", F.col("SERIE").alias("serie"), F.col("SEDE").alias("sede"), F.col("ETIQUETA IA").alias("etiqueta"))


_SINGLE_SQL = LINES_SQL + f""",
blocks AS (
  SELECT o_orderkey, {ROW_NUM} AS row_num, CASE WHEN o_orderpriority = '2-HIGH' AND l_returnflag = 'A' THEN '' ELSE 'S' END AS serie,
    o_orderpriority = '1-URGENT' AND file_no = 0 AND item = 1 AS exact, o_orderpriority = '2-HIGH' AND l_returnflag = 'A' AS no_serial,
    o_orderpriority = '3-MEDIUM' AND l_returnflag = 'R' AS gaps
  FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'
),
per_order AS (SELECT o_orderkey, min(row_num) FILTER (exact) AS e, min(row_num) FILTER (no_serial) AS s, min(row_num) FILTER (gaps) AS g, max(row_num) AS last FROM blocks GROUP BY o_orderkey),
placed AS (
  SELECT o.*, printf('%08d', o.o_orderkey) AS incoming_id, CAST(o.o_orderkey + 100000 AS VARCHAR) || '_0.docx' AS file_name, coalesce(e, s, g) AS target, last, e, s, g,
    CASE WHEN e IS NOT NULL THEN 'exact' WHEN s IS NOT NULL THEN 'no serial' WHEN g IS NOT NULL THEN 'gaps' ELSE 'new row' END AS rule,
    last IS NOT NULL AND NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O') AS room
  FROM orders o LEFT JOIN per_order p ON o.o_orderkey = p.o_orderkey
),
ends AS (SELECT max(row_num) AS top FROM (SELECT row_num FROM blocks UNION ALL SELECT last + 1 FROM placed WHERE last IS NOT NULL AND NOT room)),
appended AS (SELECT o_orderkey, row_number() OVER (ORDER BY file_name) AS rank FROM placed WHERE target IS NULL AND (NOT room OR last = (SELECT top FROM ends))),
audit AS (
  SELECT p.*, CASE WHEN target IS NOT NULL THEN 'update' WHEN a.rank IS NULL OR (a.rank = 1 AND last = top AND room) THEN 'insert_at_free' ELSE 'append' END AS action,
    CASE WHEN target IS NOT NULL THEN target WHEN a.rank IS NULL THEN last + 1 ELSE top + a.rank END AS row,
    CASE WHEN target IS NULL THEN 'RADICADO,SEDE,SERIE,ITEM,ARCHIVO' WHEN e IS NOT NULL THEN 'SEDE' WHEN s IS NOT NULL THEN 'SEDE,SERIE' ELSE 'SEDE,ITEM' END AS filled,
    CASE WHEN target IS NULL THEN '' WHEN e IS NOT NULL THEN 'RADICADO,MARCA,SERIE,SERIE TUBO RX,ITEM,ARCHIVO' WHEN s IS NOT NULL THEN 'RADICADO,MARCA,SERIE TUBO RX,ITEM,ARCHIVO'
         ELSE 'RADICADO,MARCA,SERIE,SERIE TUBO RX,ARCHIVO' END AS skipped
  FROM placed p CROSS JOIN ends LEFT JOIN appended a ON p.o_orderkey = a.o_orderkey
)"""

QUERIES = {
    "master_rows": (master_rows, f"""WITH {SHEET_SQL} SELECT row_num, CASE WHEN hollow THEN '' ELSE radicado END AS radicado, CASE WHEN hollow THEN '' ELSE file_name END AS archivo,
        CASE WHEN hollow THEN '' ELSE CAST(item AS VARCHAR) END AS item, CASE WHEN hollow THEN '' ELSE tipo END AS tipo, CASE WHEN hollow THEN '' ELSE marca END AS marca,
        CASE WHEN hollow THEN '' ELSE modelo END AS modelo, CASE WHEN hollow THEN '' ELSE serie END AS serie, CASE WHEN hollow THEN '' ELSE tubo END AS tubo, sede, etiqueta, '' AS actualizado FROM sheet"""),
    "missing_columns": (missing_columns, """SELECT name, missing FROM (VALUES ('orders', 'o_orderkey'), ('orders', 'o_orderdate'), ('orders', 'o_radicado'), ('lineitem', 'l_orderkey'), ('lineitem', 'l_serie'),
        ('lineitem', 'l_linenumber'), ('documents', 'doc_id'), ('documents', 'text'), ('documents', 'archivo')) w(name, missing)
        WHERE (name, missing) NOT IN (SELECT 'orders', column_name FROM (DESCRIBE orders) UNION ALL SELECT 'lineitem', column_name FROM (DESCRIBE lineitem) UNION ALL SELECT 'documents', column_name FROM (DESCRIBE documents))"""),
    "empty_rows": (empty_rows, f"WITH {SHEET_SQL} SELECT row_num FROM sheet WHERE hollow"),
    "placeholder_cells": (placeholder_cells, f"""WITH {EQUIPMENT_SQL} SELECT file_id, CAST(item AS BIGINT) AS item,
        CAST(SERIE IN ('', 'NO REGISTRA') AS BIGINT) AS serie, CAST(MARCA_TUBO = 'no aplica' AS BIGINT) AS marca_tubo, CAST(MODELO_TUBO = '' AS BIGINT) AS modelo_tubo,
        CAST(SERIE_TUBO = 'NO REGISTRA' AS BIGINT) AS serie_tubo FROM equipment"""),
    "block_rows": (block_rows, f"WITH {SHEET_SQL} SELECT row_num, radicado FROM sheet WHERE NOT hollow"),
    "compound_matches": (compound_matches, f"""WITH {SHEET_SQL} SELECT e.file_id || '/' || e.item AS incoming_id, row_num FROM sheet s JOIN equipment e ON e.file_id = s.file_id AND e.item = s.item
        WHERE NOT hollow AND (e.SERIE IN ('', 'NO REGISTRA') OR e.SERIE = s.serie)"""),
    "incomplete_rows": (incomplete_rows, f"""WITH {SHEET_SQL}, b AS (SELECT radicado, CAST(min(row_num) FILTER (l_returnflag <> 'N') AS VARCHAR) AS no_serial_row FROM sheet WHERE NOT hollow GROUP BY radicado)
        SELECT file_id || '/' || item AS incoming_id, no_serial_row, CAST(NULL AS VARCHAR) AS gappy_row FROM equipment JOIN b USING (radicado)"""),
    "audited_numbers": (audited_numbers, f"WITH {SHEET_SQL} SELECT DISTINCT radicado FROM sheet WHERE etiqueta = 'antes'"),
    "block_extents": (block_extents, f"WITH {SHEET_SQL} SELECT radicado, min(row_num) AS first_row, max(row_num) AS last_row, count(*) AS n_rows FROM sheet WHERE NOT hollow GROUP BY radicado"),
    "free_rows": (free_rows, f"""WITH {SHEET_SQL}, b AS (SELECT radicado, max(row_num) + 1 AS free_row FROM sheet WHERE NOT hollow GROUP BY radicado)
        SELECT radicado, free_row FROM b WHERE free_row NOT IN (SELECT row_num FROM sheet WHERE NOT hollow)"""),
    "placement_rules": (placement_rules, f"WITH {_SINGLE_SQL} SELECT incoming_id, rule, CAST(target AS VARCHAR) AS target FROM placed"),
    "upsert_single_audit": (upsert_single_audit, f"WITH {_SINGLE_SQL} SELECT incoming_id, action, row, filled, skipped FROM audit"),
    "upsert_single_master": (upsert_single_master, f"""WITH {_SINGLE_SQL},
        written AS (SELECT row AS row_num, action, CASE WHEN e IS NOT NULL OR g IS NOT NULL THEN 'S' ELSE 'NO REGISTRA' END AS serie, 'sur' AS sede,
          CASE WHEN action = 'update' THEN '2024-06-30 00:00:00Z: Llenadas: ' || list_aggregate(list_sort(string_split(filled, ',')), 'string_agg', ', ') || '. Saltadas: '
            || list_aggregate(list_sort(string_split(skipped, ',')), 'string_agg', ', ') || '.' ELSE '2024-06-30 00:00:00Z: Fila nueva. Llenadas: ' || replace(filled, ',', ', ') || '.' END AS etiqueta FROM audit)
        SELECT row_num, serie, sede, etiqueta FROM written
        UNION ALL SELECT row_num, serie, '', '' FROM blocks WHERE row_num NOT IN (SELECT row_num FROM written)
        UNION ALL SELECT last + 1, '', '', '' FROM placed WHERE last IS NOT NULL AND NOT room"""),
    "upsert_audit": (upsert_audit, f"""WITH {_MERGED_SQL} SELECT file_id || '/' || item AS incoming_id, radicado, coalesce(new_action, 'update') AS action, row_num AS row,
        CASE WHEN new_action IS NOT NULL THEN 'RADICADO,SEDE,TIPO DE EQUIPO,MARCA,MODELO,SERIE,SERIE TUBO RX,ITEM,ARCHIVO' WHEN no_site THEN 'SEDE' ELSE '' END AS filled,
        CASE WHEN new_action IS NOT NULL THEN '' WHEN no_site THEN 'RADICADO,TIPO DE EQUIPO,MARCA,MODELO,SERIE,SERIE TUBO RX,ITEM,ARCHIVO'
             ELSE 'RADICADO,SEDE,TIPO DE EQUIPO,MARCA,MODELO,SERIE,SERIE TUBO RX,ITEM,ARCHIVO' END AS skipped, 'NOTA' AS missing FROM merged"""),
    "upsert_master": (upsert_master, f"""WITH {_MERGED_SQL} SELECT row_num, radicado, CAST(item AS VARCHAR) AS item, own_serial AS serie, CASE WHEN new_action IS NULL THEN 'T1' ELSE 'T2' END AS tubo,
        CASE WHEN new_action IS NULL AND NOT no_site THEN 'centro' ELSE 'sur' END AS sede,
        CASE WHEN new_action IS NOT NULL THEN '2024-06-30 00:00:00Z: Fila nueva. Llenadas: RADICADO, SEDE, TIPO DE EQUIPO, MARCA, MODELO, SERIE, SERIE TUBO RX, ITEM, ARCHIVO. Sin columna: NOTA.'
             ELSE CASE WHEN l_returnflag = 'A' THEN 'antes' || chr(10) ELSE '' END || '2024-06-30 00:00:00Z: ' ||
               CASE WHEN no_site THEN 'Llenadas: SEDE. Saltadas: {_OLD_SKIPS.replace(' SEDE,', '')}.' ELSE 'Saltadas: {_OLD_SKIPS}.' END || ' Sin columna: NOTA.' END AS etiqueta,
        '2024-06-30T00:00:00Z' AS actualizado FROM merged"""),
    "master_writes": (master_writes, f"WITH {_MERGED_SQL} SELECT 'delta' AS kind, count(*) AS n FROM merged UNION ALL SELECT 'base', count(*) FROM merged WHERE new_action IS NULL"),
    "upsert_summary": (upsert_summary, f"WITH {_MERGED_SQL} SELECT coalesce(new_action, 'update') AS action, count(*) AS n FROM merged GROUP BY 1"),
}
QUERIES["master_of_batches"] = (master_of_batches, QUERIES["upsert_master"][1])
