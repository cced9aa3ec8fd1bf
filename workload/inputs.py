"""Inputs of the registered queries: domain tables derived by Spark from the given tables.

Every builder has a SQL twin (``*_SQL``) with the same meaning, used by the checks. Variants hang on
business columns (order status and priority, line number, return flag), so whole tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fichero.sources.tables import read_table


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread_table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows get costly text work next."""
    return read_table(spark, f"{d}/{name}.parquet", *columns)


def day(c) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines, numbered within their order: an order is one licence file of its natural size."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").withColumn("file_no", F.lit(0).cast("long")).withColumn("item", F.row_number().over(order))


LINES_SQL = """
lines AS (
  SELECT *, CAST(0 AS BIGINT) AS file_no,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS item
  FROM lineitem
)"""


def filing_number_of(key: Column) -> Column:
    return (key + 100000).cast("string")


def file_id_of(key: Column, file_no: Column) -> Column:
    return F.format_string("%08d_%d", key, file_no)


def equipment(spark: SparkSession, d: str) -> DataFrame:
    """One row per piece of equipment: order line with its part, supplier and order."""
    part, supp = table(spark, d, "part"), table(spark, d, "supplier")
    # lines are sorted by order already; orders grow with them and are never sent out whole
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").hint("merge")
    return (
        lines(spark, d)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        # parts bring the most text; joined last, it is not dealt out again by supplier
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey", "file_no", "item", "l_linenumber", "o_orderstatus", "o_orderpriority", "l_returnflag",
            filing_number_of(F.col("l_orderkey")).alias("radicado"),
            file_id_of(F.col("l_orderkey"), F.col("file_no")).alias("file_id"),
            F.concat(filing_number_of(F.col("l_orderkey")), F.lit("_"), F.col("file_no"), F.lit("_CHECKLIST.docx")).alias("file_name"),
            F.col("p_type").alias("TIPO_DE_EQUIPO"),
            F.col("p_brand").alias("MARCA"),
            F.col("p_name").alias("MODELO"),
            serial(F.col("l_partkey"), F.col("l_suppkey")).alias("SERIE"),
            F.concat(F.lit("S"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey")).alias("own_serial"),
            F.when(F.col("l_suppkey") % 3 == 0, "no aplica").otherwise(F.concat(F.lit(" t-"), F.col("p_brand"), F.lit(" "))).alias("MARCA_TUBO"),
            F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("M"), F.col("p_size"))).alias("MODELO_TUBO"),
            F.when(F.col("l_suppkey") % 3 == 1, "NO REGISTRA").otherwise(F.concat(F.lit("X"), F.col("l_partkey"))).alias("SERIE_TUBO"),
            day("o_orderdate").alias("FECHA_FABRICACION"),
            F.col("s_name").alias("EMPRESA_QC"),
            day("l_shipdate").alias("FECHA_QC"),
            F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("int").cast("string")).otherwise("").alias("KV"),
        )
    )


EQUIPMENT_SQL = LINES_SQL + """,
equipment AS (
  SELECT l_orderkey, file_no, item, l_linenumber, o_orderstatus, o_orderpriority, l_returnflag,
    CAST(l_orderkey + 100000 AS VARCHAR) AS radicado,
    printf('%08d_%d', l_orderkey, file_no) AS file_id,
    (l_orderkey + 100000) || '_' || file_no || '_CHECKLIST.docx' AS file_name,
    p_type AS TIPO_DE_EQUIPO, p_brand AS MARCA, p_name AS MODELO,
    CASE WHEN l_partkey % 5 = 0 THEN 'NO REGISTRA' WHEN l_partkey % 7 = 0 THEN '' ELSE 'S' || l_partkey || '-' || l_suppkey END AS SERIE,
    'S' || l_partkey || '-' || l_suppkey AS own_serial,
    CASE WHEN l_suppkey % 3 = 0 THEN 'no aplica' ELSE ' t-' || p_brand || ' ' END AS MARCA_TUBO,
    CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'M' || p_size END AS MODELO_TUBO,
    CASE WHEN l_suppkey % 3 = 1 THEN 'NO REGISTRA' ELSE 'X' || l_partkey END AS SERIE_TUBO,
    strftime(o_orderdate, '%d/%m/%Y') AS FECHA_FABRICACION,
    s_name AS EMPRESA_QC, strftime(l_shipdate, '%d/%m/%Y') AS FECHA_QC,
    CASE WHEN l_returnflag = 'A' THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE '' END AS KV
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey
)"""


def serial(part: Column, supp: Column) -> Column:
    return (
        F.when(part % 5 == 0, "NO REGISTRA").when(part % 7 == 0, "")
        .otherwise(F.concat(F.lit("S"), part, F.lit("-"), supp))
    )


def headers(spark: SparkSession, d: str) -> DataFrame:
    """One row per licence header: order with customer, nation and region."""
    cust, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (
        table(spark, d, "orders")
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment",
            filing_number_of(F.col("o_orderkey")).alias("radicado"),
            F.when(prio == "1-URGENT", "PERSONA NATURAL").when(prio == "2-HIGH", "Natural ")
            .when(prio == "3-MEDIUM", "Persona Jurídica").when(prio == "4-NOT SPECIFIED", "jurídica").otherwise("").alias("TIPO_SOLICITANTE"),
            F.when(F.col("c_mktsegment") == "BUILDING", "CATEGORIA 1").when(F.col("c_mktsegment") == "MACHINERY", "Categoría II")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "PERIAPICAL").when(F.col("c_mktsegment") == "FURNITURE", "panorámico")
            .otherwise("CATEGORIA I").alias("CATEGORIA"),
            F.col("c_name").alias("NOMBRE_SOLICITANTE"),
            F.when(status == "P", "").otherwise(F.col("c_custkey").cast("string")).alias("NIT_CC"),
            F.concat(F.lit(" Sede "), F.col("n_name")).alias("SEDE"),
            F.concat(F.lit("Calle "), F.col("o_custkey")).alias("DIRECCION"),
            F.col("n_name").alias("MUNICIPIO"),
            F.when(status == "O", F.lower("r_name")).otherwise(F.col("r_name")).alias("SUBREGION"),
            F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.COM ")).alias("CORREO"),
            F.concat(F.lit("R-"), F.col("o_orderkey")).alias("RESOLUCION"),
            F.when(prio == "1-URGENT", F.date_format("o_orderdate", "d/M/yy")).when(prio == "2-HIGH", F.concat(F.lit("31/02/"), F.year("o_orderdate")))
            .when(prio == "3-MEDIUM", F.concat(F.lit("05-13-"), F.year("o_orderdate"))).when(prio == "4-NOT SPECIFIED", "")
            .otherwise(F.date_format("o_orderdate", " dd-MM-yyyy ")).alias("FECHA_RESOLUCION"),
            "o_orderdate",
        )
    )


HEADERS_SQL = """
headers AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment, CAST(o_orderkey + 100000 AS VARCHAR) AS radicado,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'PERSONA NATURAL' WHEN '2-HIGH' THEN 'Natural ' WHEN '3-MEDIUM' THEN 'Persona Jurídica'
         WHEN '4-NOT SPECIFIED' THEN 'jurídica' ELSE '' END AS TIPO_SOLICITANTE,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'CATEGORIA 1' WHEN 'MACHINERY' THEN 'Categoría II' WHEN 'HOUSEHOLD' THEN 'PERIAPICAL'
         WHEN 'FURNITURE' THEN 'panorámico' ELSE 'CATEGORIA I' END AS CATEGORIA,
    c_name AS NOMBRE_SOLICITANTE, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS NIT_CC,
    ' Sede ' || n_name AS SEDE, 'Calle ' || o_custkey AS DIRECCION, n_name AS MUNICIPIO,
    CASE WHEN o_orderstatus = 'O' THEN lower(r_name) ELSE r_name END AS SUBREGION, r_name, n_name,
    ' ' || c_name || '@Example.COM ' AS CORREO, 'R-' || o_orderkey AS RESOLUCION, o_orderdate, o_custkey, c_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
