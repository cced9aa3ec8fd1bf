"""Scalar text and date rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fichero.functions import dates, text
from workload.inputs import HEADERS_SQL, headers, spread_table, table


def _documents(column):
    def query(spark, d):
        return spread_table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(column(F.col("text"))).alias("digest"))

    return query


def licence_documents(spark, d):
    """One licence text per order; where (and whether) it names its number varies with the priority."""
    number = F.col("o_orderkey") + 100000
    prio = F.col("o_orderpriority")
    filler = F.array_join(F.array_repeat(F.lit("linea sin datos"), 50), "\n")
    body = (
        F.when(prio == "1-URGENT", F.concat(F.lit("LICENCIA\nRadicado: "), number, F.lit("\nfin")))
        .when(prio == "2-HIGH", F.concat(F.lit("LICENCIA\nexpediente RADICADO-"), number, F.lit(" de 2024")))
        .when(prio == "3-MEDIUM", F.concat(F.lit("LICENCIA\n   "), number, F.lit(" solicitud")))
        .when(prio == "4-NOT SPECIFIED", F.concat(filler, F.lit("\nRadicado: "), number))
        .otherwise(F.concat(F.lit("Radicado: 12345\nsin otro dato "), number))
    )
    name = F.when(
        F.col("o_orderstatus") == "P", F.concat(F.lit("LIC_"), number, F.lit("_99.docx"))
    ).otherwise(F.concat(F.lit("licencia_"), F.col("o_orderkey") % 1000, F.lit(".docx")))
    return spread_table(spark, d, "orders").select(
        F.format_string("%08d_doc", "o_orderkey").alias("file_id"), name.alias("name"),
        F.col("o_orderdate").alias("modified_time"), body.alias("text"), "o_orderkey",
    )


def filing_numbers(spark, d):
    docs = licence_documents(spark, d)
    return docs.select("file_id", text.filing_number(F.col("name"), F.col("text")).alias("radicado"))


def head_filing_numbers(spark, d):
    """The same with a limit, as its feature: only the first 50 lines of a text are read."""
    docs = licence_documents(spark, d)
    return docs.select("file_id", text.filing_number(F.col("name"), F.col("text"), first_lines=50).alias("radicado"))


def cache_keys(spark, d):
    docs = licence_documents(spark, d)
    number = (F.col("o_orderkey") + 100000).cast("string")
    no_id = F.lit(None).cast("string")
    return docs.select(
        "file_id",
        text.cache_key(number, F.col("file_id"), F.col("name")).alias("with_id"),
        text.cache_key(number, no_id, F.concat(F.lit("/in/Año nº "), F.col("name"))).alias("from_name"),
        text.cache_key(number, F.lit(""), F.lit("")).alias("without_name"),
    )


def report_identifiers(spark, d):
    prefix = F.when(F.col("l_returnflag") == "N", F.lit("rep")).otherwise(F.col("l_partkey").cast("string"))
    tail = F.when(F.col("l_linestatus") == "F", ".pdf").otherwise("_equipo.v2.pdf")
    path = F.concat(F.lit("/qc/2024/"), prefix, tail)
    return spread_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.report_identifier(path).alias("identifier"))


def output_names(spark, d):
    h = headers(spark, d)
    stem = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/in/x_"), F.regexp_replace("NOMBRE_SOLICITANTE", "#", "_"), F.lit("_CHECKLIST.docx")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("in/"), F.col("c_mktsegment"), F.lit(".docx")))
        .otherwise(F.concat(F.col("c_mktsegment"), F.lit("_v1.docx")))
    )
    return h.select(
        "radicado", text.output_name(stem, F.col("radicado")).alias("plain"),
        text.output_name(stem, F.concat(F.lit(" ab"), F.col("radicado")), F.lit(" sede niquía ")).alias("suffixed"),
    )


def applicant_types(spark, d):
    return headers(spark, d).select("radicado", text.applicant_type(F.col("TIPO_SOLICITANTE")).alias("persona"))


def licence_categories(spark, d):
    return headers(spark, d).select(
        "radicado", text.licence_category(F.col("CATEGORIA")).alias("categoria"),
        text.licence_category(F.col("CATEGORIA"), roman_i=True).alias("with_roman_i"),
        text.first_category(F.lit(""), F.col("MUNICIPIO"), F.col("CATEGORIA")).alias("first_named"),
    )


def emails(spark, d):
    return headers(spark, d).select("radicado", text.email(F.col("CORREO")).alias("email"))


def resolution_dates(spark, d):
    parts = dates.resolution_day(F.col("FECHA_RESOLUCION"))
    return headers(spark, d).select(
        "radicado", parts["day"].alias("dia"), parts["month"].alias("mes"), parts["year"].alias("ano")
    )


def issue_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.issue_date(F.col("o_orderdate")).alias("issued"))


def run_stamps(spark, d):
    stamp = dates.run_stamp(F.col("ts"))
    return table(spark, d, "events").select("event_id", stamp.alias("stamp"), dates.audit_stamp(stamp).alias("audit_stamp"))


def latest_qc_dates(spark, d):
    first = F.date_format("l_shipdate", "dd/MM/yyyy")
    second = F.date_format(F.date_add("l_shipdate", F.col("l_linenumber") - 4), "d/M/yyyy")
    note = F.concat(F.lit("CC el "), first, F.lit("; repetido "), second, F.lit("; erróneo 31/02/2099; código 1/2/30000"))
    return spread_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.latest_date(note).alias("fecha_cc")
    )


def text_budget(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(F.substring(t, 1, 25000)).alias("first_try"), F.md5(F.substring(t, 1, 18000)).alias("third_try")
    )


_UPPER = "upper(replace({}, 'ß', 'SS'))"

QUERIES = {
    "accent_free_text": (_documents(text.strip_accents), "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents"),
    "label_keys": (
        _documents(text.label_key),
        f"SELECT doc_id, md5(trim(regexp_replace({_UPPER.format('strip_accents(text)')}, '[^A-Z0-9]+', ' ', 'g'))) AS digest FROM documents",
    ),
    "value_keys": (
        _documents(text.value_key),
        f"SELECT doc_id, md5({_UPPER.format('''trim(text, chr(10) || chr(9) || chr(13) || chr(160) || ' ')''')}) AS digest FROM documents",
    ),
    "marker_keys": (
        _documents(text.placeholder_key),
        f"SELECT doc_id, md5(trim(regexp_replace({_UPPER.format('strip_accents(text)')}, '[^A-Z0-9]+', '_', 'g'), '_')) AS digest FROM documents",
    ),
    "filing_numbers": (
        filing_numbers,
        """SELECT printf('%08d_doc', o_orderkey) AS file_id,
             CASE WHEN o_orderstatus = 'P' OR o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
                  THEN CAST(o_orderkey + 100000 AS VARCHAR) END AS radicado FROM orders""",
    ),
    "head_filing_numbers": (
        head_filing_numbers,
        """SELECT printf('%08d_doc', o_orderkey) AS file_id,
             CASE WHEN o_orderstatus = 'P' OR o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
                  THEN CAST(o_orderkey + 100000 AS VARCHAR) END AS radicado FROM orders""",
    ),
    "cache_keys": (
        cache_keys,
        """WITH k AS (SELECT o_orderkey, CAST(o_orderkey + 100000 AS VARCHAR) AS n,
               CASE WHEN o_orderstatus = 'P' THEN 'LIC_' || (o_orderkey + 100000) || '_99' ELSE 'licencia_' || (o_orderkey % 1000) END AS stem FROM orders)
           SELECT printf('%08d_doc', o_orderkey) AS file_id, n || '__' || printf('%08d_doc', o_orderkey) AS with_id,
             n || '__' || 'Año_nº_' || stem AS from_name, n || '__local' AS without_name FROM k""",
    ),
    "report_identifiers": (
        report_identifiers,
        """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS identifier FROM lineitem""",
    ),
    "output_names": (
        output_names,
        f"""WITH {HEADERS_SQL}, n AS (SELECT radicado, CASE o_orderstatus WHEN 'F' THEN replace(c_name, '#', '_') || '_LICENCIA'
                 WHEN 'O' THEN 'LICENCIA' ELSE 'v1_LICENCIA' END AS tail FROM headers)
            SELECT radicado, radicado || '_' || tail AS plain, 'AB' || radicado || '_' || tail || '_SEDE_NIQUIA' AS suffixed FROM n""",
    ),
    "applicant_types": (
        applicant_types,
        f"""WITH {HEADERS_SQL} SELECT radicado, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PERSONA NATURAL'
            WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'PERSONA JURIDICA' END AS persona FROM headers""",
    ),
    "licence_categories": (
        licence_categories,
        f"""WITH {HEADERS_SQL}, c AS (SELECT radicado, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'CATEGORIA 1'
            WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'CATEGORIA 2' END AS categoria FROM headers)
            SELECT radicado, categoria, coalesce(categoria, 'CATEGORIA 1') AS with_roman_i, categoria AS first_named FROM c""",
    ),
    "emails": (emails, f"WITH {HEADERS_SQL} SELECT radicado, lower(c_name) || '@example.com' AS email FROM headers"),
    "resolution_dates": (
        resolution_dates,
        f"""WITH {HEADERS_SQL}, m AS (SELECT *, list_extract(['ENERO','FEBRERO','MARZO','ABRIL','MAYO','JUNIO','JULIO','AGOSTO','SEPTIEMBRE',
              'OCTUBRE','NOVIEMBRE','DICIEMBRE'], CAST(month(o_orderdate) AS INT)) AS month_name FROM headers)
            SELECT radicado,
              CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN CAST(day(o_orderdate) AS VARCHAR) WHEN o_orderpriority = '2-HIGH' THEN '31' END AS dia,
              CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN month_name WHEN o_orderpriority = '2-HIGH' THEN 'FEBRERO' END AS mes,
              CASE WHEN o_orderpriority = '1-URGENT' THEN '20' || strftime(o_orderdate, '%y')
                   WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN strftime(o_orderdate, '%Y') END AS ano FROM m""",
    ),
    "issue_dates": (issue_dates, "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS issued FROM orders"),
    "run_stamps": (
        run_stamps,
        "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%SZ') AS audit_stamp FROM events",
    ),
    "latest_qc_dates": (
        latest_qc_dates,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
             strftime(greatest(CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + (l_linenumber - 4)), '%d/%m/%Y') AS fecha_cc FROM lineitem""",
    ),
    "text_budget": (
        text_budget,
        "SELECT doc_id, md5(left(text, 25000)) AS first_try, md5(left(text, 18000)) AS third_try FROM documents",
    ),
}
