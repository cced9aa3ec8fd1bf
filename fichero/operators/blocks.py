"""Lookups in the master table, which is made of blocks: all rows of one filing number.

A block can be of any size. No operator here pairs every incoming row with every row of its block;
joins carry the whole comparison key, and per-block answers are aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fichero.functions.plan import evaluated_once
from fichero.functions.text import blank, nonblank, placeholder_empty, py_trim, text_or_empty


@dataclass(frozen=True)
class Layout:
    """Columns of the master table and the roles some of them play."""

    headers: list[str]
    number: str = "RADICADO"
    audit: str = "ETIQUETA IA"
    archive: str = "ARCHIVO"
    updated: str = "Última actualización"
    # Columns that tell two pieces of equipment apart, besides the number and the file.
    serial: str = "SERIE"
    serials: list[str] = field(default_factory=lambda: ["SERIE", "SERIE TUBO RX"])
    backup_keys: list[str] = field(default_factory=lambda: ["TIPO DE EQUIPO", "MARCA", "MODELO"])

    @property
    def key_parts(self) -> list[str]:
        parts = [self.serial, "ITEM", self.archive, *self.backup_keys]
        return [p for p in parts if p in self.headers]


# How many of at least how many target cells must be empty for a row to count as incomplete.
MIN_TARGETS = 4
MIN_EMPTY = 3


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def sheet_rows(raw: DataFrame, header: list[str]) -> DataFrame:
    """Ragged sheet rows (row_num, cells) as one text column per trimmed header, padded with ''."""
    return raw.select(
        "row_num", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(h.strip()) for i, h in enumerate(header)]
    )


def missing_columns(spark: SparkSession, columns: list[str], required: list[str]) -> DataFrame:
    """Required columns that a table does not have."""
    return spark.createDataFrame([(c,) for c in required if c not in columns], "missing string")


def row_is_empty(headers: list[str]) -> Column:
    return F.forall(F.array(*[text_or_empty(quoted(h)) for h in headers]), blank)


def occupied_rows(master: DataFrame, layout: Layout) -> DataFrame:
    """Rows with a value; the test is computed first, as filters over many columns optimize badly."""
    return evaluated_once(master, "_empty", row_is_empty(layout.headers)).filter("NOT _empty").drop("_empty")


def block_rows(incoming: DataFrame, master: DataFrame, layout: Layout) -> DataFrame:
    """Master rows of the incoming filing numbers; numbers compare as they are, untrimmed."""
    numbers = incoming.select(F.col("radicado").alias(layout.number)).distinct()
    return master.join(numbers, layout.number, "left_semi")


def numbers_with_value(master: DataFrame, layout: Layout, column: str) -> DataFrame:
    """Filing numbers of which some row has a value in ``column``; none when there is no such column."""
    number = F.col(layout.number)
    if column not in master.columns:
        return master.select(number.alias("radicado")).limit(0)
    return (
        master.groupBy(number.alias("radicado")).agg(F.bool_or(~blank(quoted(column))).alias("has_value"))
        .filter("has_value").select("radicado")
    )


def block_extents(master: DataFrame, layout: Layout) -> DataFrame:
    return master.groupBy(F.col(layout.number).alias("radicado")).agg(
        F.min("row_num").alias("first_row"), F.max("row_num").alias("last_row"), F.count("*").alias("n_rows")
    )


def free_row_after_block(master: DataFrame, layout: Layout) -> DataFrame:
    """Row right below every block, where that row holds nothing; a row beyond the table is empty too."""
    occupied = occupied_rows(master, layout).select(F.col("row_num").alias("free_row"))
    probes = block_extents(master.filter(~blank(F.col(layout.number))), layout).select("radicado", (F.col("last_row") + 1).alias("free_row"))
    return probes.join(occupied, "free_row", "left_anti")


def serial_missing(layout: Layout) -> Column:
    """Whether one of the serial columns the table has is empty or a placeholder."""
    present = [placeholder_empty(quoted(c)) for c in layout.serials if c in layout.headers]
    return F.exists(F.array(*present), lambda e: e) if present else F.lit(False)


# --- compound key -------------------------------------------------------------------------


def incoming_key(layout: Layout) -> dict[str, Column]:
    """Part of the compound key per column: null where the incoming row does not state it."""
    fields = F.col("fields")
    parts = {p: nonblank(fields[p]) for p in layout.key_parts}
    if layout.serial in parts:
        parts[layout.serial] = F.when(~placeholder_empty(fields[layout.serial]), parts[layout.serial])
    if layout.archive in parts:
        parts[layout.archive] = F.nullif(F.col("file_name"), F.lit(""))
    return parts


def compound_first_match(incoming: DataFrame, master: DataFrame, layout: Layout) -> DataFrame:
    """Lowest master row equal to every key part an incoming row states: (incoming_id, row_num).

    Which parts count differs from row to row, so the set of stated parts, as a bit mask, becomes one more join
    key: master rows take part once per set that occurs for their number (64 at most), are reduced to the
    first row per key, and meet the incoming rows in an equi-join on the whole key.
    """
    parts = incoming_key(layout)
    names = [f"_k{i}" for i in range(len(parts))]
    keys = incoming.select("incoming_id", "radicado", *[p.alias(n) for n, p in zip(names, parts.values())])
    stated = sum((F.when(F.col(n).isNotNull(), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    asked = keys.select("incoming_id", "radicado", stated.alias("_stated"), *[F.coalesce(n, F.lit("")).alias(n) for n in names])
    sets = asked.select("radicado", "_stated").distinct()
    offered = (
        master.select(F.col(layout.number).alias("radicado"), "row_num", *[py_trim(quoted(p)).alias(n) for n, p in zip(names, parts)])
        .join(sets, "radicado")
        .select("radicado", "row_num", "_stated", *[F.when(F.col("_stated").bitwiseAND(1 << i) != 0, F.col(n)).otherwise("").alias(n) for i, n in enumerate(names)])
        .groupBy("radicado", "_stated", *names).agg(F.min("row_num").alias("row_num"))
    )
    return asked.join(offered, ["radicado", "_stated", *names]).select("incoming_id", "row_num")


# --- gaps -----------------------------------------------------------------------------------

# Bits of one mask; a wider table takes several.
_MASK_BITS = 62


def header_masks(headers: list[str], bit) -> Column:
    """One bit per header, in groups of ``_MASK_BITS``: set where ``bit(header)`` holds."""
    parts = [headers[i : i + _MASK_BITS] for i in range(0, len(headers), _MASK_BITS)]
    zero = F.lit(0).cast("long")
    return F.array(*[sum((F.when(bit(h), F.lit(1 << i).cast("long")).otherwise(zero) for i, h in enumerate(part)), zero) for part in parts])


def gap_index(master: DataFrame, layout: Layout) -> DataFrame:
    """(radicado, gaps, row_num): which cells are empty, as bit masks, and the first row of each number with just these.

    Rows that lack the same cells are one, so an index of a number of any size has as many rows as it knows patterns.
    """
    rows = evaluated_once(master.select("row_num", *map(quoted, layout.headers)), "gaps", header_masks(layout.headers, lambda h: placeholder_empty(quoted(h))))
    return rows.groupBy(F.col(layout.number).alias("radicado"), "gaps").agg(F.min("row_num").alias("row_num"))


def first_incomplete_rows(incoming: DataFrame, master: DataFrame, layout: Layout) -> DataFrame:
    """First row to reuse per incoming row: one without serial, else one with many empty targets.

    Incoming rows ask by the bit mask of their target columns, so equal ones of a number share an answer; they meet the
    number's patterns of gaps, not its rows.
    """
    targets = F.filter(F.map_keys("fields"), lambda k: k.isin(layout.headers))
    asked = evaluated_once(incoming.select("incoming_id", "radicado", targets.alias("_known")), "_targets", header_masks(layout.headers, lambda h: F.array_contains("_known", h))).drop("_known")
    index = gap_index(master, layout).join(asked.select("radicado").distinct(), "radicado", "left_semi")
    serial = header_masks(layout.headers, lambda h: F.lit(h in layout.serials))

    def shared(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("int")), F.lit(0), lambda n, x: n + x)

    no_serial = index.where(shared(F.col("gaps"), serial) > 0).groupBy("radicado").agg(F.min("row_num").alias("no_serial_row"))
    sets = asked.select("radicado", "_targets").distinct().where(shared(F.col("_targets"), F.col("_targets")) >= MIN_TARGETS)
    gappy = index.join(sets, "radicado").where(shared(F.col("gaps"), F.col("_targets")) >= MIN_EMPTY).groupBy("radicado", "_targets").agg(F.min("row_num").alias("gappy_row"))
    known = index.select("radicado").distinct()
    return (
        asked.join(known, "radicado").join(no_serial, "radicado", "left").join(gappy, ["radicado", "_targets"], "left")
        .select("incoming_id", "no_serial_row", "gappy_row")
    )
