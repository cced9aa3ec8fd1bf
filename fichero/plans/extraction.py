"""From raw model replies to one row of fields per piece of equipment."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from fichero.functions.labels import literal_map
from fichero.functions.plan import evaluated_once
from fichero.functions.text import blank, cache_key, email, id_of_cache_key, nonblank, py_trim
from fichero.functions.vocabulary import (
    ABBREVIATIONS, ADMINISTRATIVE_REQUESTS, NOT_RECORDED, QC_BODIES, UNKNOWN_QC_BODY,
)

LICENCE = "map<string,string>"
EQUIPMENT_LIST = "array<map<string,string>>"

# Fields of one piece of equipment that may stand at the top level of a reply.
FLAT_EQUIPMENT = [
    "TIPO DE EQUIPO", "FECHA DE FABRICACION", "FECHA DE FABRICACIÓN", "MARCA", "MODELO", "SERIE",
    "MARCA TUBO RX", "MODELO TUBO RX", "SERIE TUBO RX", "CONTROL CALIDAD", "FECHA CC",
]

# Reply field -> registry column, where the two differ.
FIELD_MAP = {
    "NOMBRE O RAZON SOCIAL": "NOMBRE O RAZÓN SOCIAL",
    "DIRECCION": "DIRECCIÓN",
    "SUBREGION": "SUBREGIÓN",
    "CORREO ELECTRONICO": "CORREO ELECTRÓNICO",
    "CATEGORIA": "CATEGORÍA",
    "FECHA DE FABRICACION": "FECHA DE FABRICACIÓN",
}

_JSON = {"allowSingleQuotes": "false"}


# --- tolerant parsing ---------------------------------------------------------------------


def _straight(raw: Column) -> Column:
    """Straight quotes, outer space removed. A text with as many bytes as characters has no other quotes; translate is slow."""
    return py_trim(F.when(F.octet_length(raw) == F.length(raw), raw).otherwise(F.translate(raw, "“”‘’", "\"\"''")))


def _unfenced(text: Column) -> Column:
    """A code fence removed from a plain column."""
    fence = r"(?i)```(?:json)?\s*([\s\S]*?)```"
    return F.when(text.contains("```") & text.rlike(fence), py_trim(F.regexp_extract(text, fence, 1))).otherwise(text)


def _balanced_block(text: Column) -> Column:
    """First ``{...}`` with balanced braces; a fold over brace-delimited pieces, not over characters."""
    body = text.substr(F.instr(text, "{"), F.length(text))
    pieces = F.split(body, r"(?<=[{}])")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("closed"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        return F.when(state["closed"], state).otherwise(
            F.struct(
                depth.alias("depth"), (state["length"] + F.length(piece)).alias("length"),
                (piece.endswith("}") & (depth == 0)).alias("closed"),
            )
        )

    def cut(end: Column) -> Column:
        return F.when(end["closed"], F.substring(body, F.lit(1), end["length"]))

    return F.when(text.contains("{"), F.aggregate(pieces, start, step, cut))


def _without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``licence`` (map, null when hopeless) and ``reason`` to a table of raw replies."""
    text, block, whole = F.col("_text"), F.col("_block"), F.col("_whole")
    parsed = F.coalesce(
        whole,
        F.from_json(block, LICENCE, _JSON),
        F.from_json(_without_trailing_commas(F.coalesce(block, text)), LICENCE, _JSON),
    )
    # each step is computed once: a reply that can be read as it is gets parsed one single time
    steps = evaluated_once(replies, "_text", _straight(F.col(raw)))
    steps = evaluated_once(steps, "_text", _unfenced(text))
    steps = evaluated_once(steps, "_whole", F.from_json(text, LICENCE, _JSON))
    steps = evaluated_once(steps, "_block", F.when(whole.isNull(), _balanced_block(text)))
    return (
        evaluated_once(steps, "licence", parsed)
        .withColumn(
            "reason",
            F.when(blank(F.col(raw)), "empty reply").when(F.col("licence").isNull(), "reply is not JSON"),
        )
        .drop("_text", "_whole", "_block")
    )


# --- normal form --------------------------------------------------------------------------


def equipment_list(licence: Column) -> Column:
    """The equipment list, never empty: without one it is made of the flat equipment fields."""
    listed = F.from_json(licence["EQUIPOS"], EQUIPMENT_LIST, _JSON)
    flat = F.map_filter(licence, lambda k, v: k.isin(FLAT_EQUIPMENT) & ~blank(v))
    # named once, so that the list is parsed once
    some = F.get(F.filter(F.array(listed), lambda l: F.size(l) > 0), F.lit(0))  # noqa: E741
    return F.coalesce(some, F.array(flat))


def with_number(licence: Column, number: Column) -> Column:
    """Key ``Radicado`` renamed unless ``RADICADO`` exists, and a blank number filled in."""
    own = F.map_contains_key(licence, "RADICADO")
    renamed = F.when(own, licence).otherwise(
        F.transform_keys(licence, lambda k, v: F.when(k == "Radicado", "RADICADO").otherwise(k))
    )
    value = F.coalesce(nonblank(renamed["RADICADO"]), number)
    return F.when(blank(renamed["RADICADO"]), F.map_concat(renamed, F.create_map(F.lit("RADICADO"), value))).otherwise(renamed)


def with_lower_email(fields: Column) -> Column:
    keys = ["CORREO ELECTRONICO", "CORREO ELECTRÓNICO"]
    return F.transform_values(fields, lambda k, v: F.when(k.isin(keys), email(v)).otherwise(v))


def licence_rows(licences: DataFrame) -> DataFrame:
    """One row per piece of equipment: header fields overridden by its own, plus ITEM and ARCHIVO.

    Needs ``licence``, ``radicado`` and ``file_name``; keeps every other column.
    """
    base = F.map_filter("licence", lambda k, v: k != "EQUIPOS")
    others = [c for c in licences.columns if c != "licence"]
    return (
        licences.withColumn("licence", with_lower_email(with_number(F.col("licence"), F.col("radicado"))))
        .select(*others, base.alias("_base"), F.posexplode(equipment_list(F.col("licence"))).alias("_pos", "_own"))
        .withColumn("item", F.col("_pos") + 1)
        .withColumn(
            "fields",
            F.map_concat(
                "_base", F.coalesce("_own", F.create_map().cast(LICENCE)),
                F.create_map(F.lit("ITEM"), F.col("item").cast("string"), F.lit("ARCHIVO"), F.col("file_name")),
            ),
        )
        .drop("_base", "_own", "_pos")
    )


def renamed_fields(fields: Column, field_map: dict[str, str] = FIELD_MAP) -> Column:
    """Fields under their registry column; of two that meet in one column the later one stays."""
    names = literal_map(field_map.items())
    return F.transform_keys(fields, lambda k, v: F.coalesce(F.element_at(names, k), k))


def known_fields(fields: Column, headers: list[str]) -> Column:
    return F.map_filter(fields, lambda k, v: k.isin(headers))


def unknown_fields(fields: Column, headers: list[str]) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.isin(headers))


def house_style(fields: Column) -> Column:
    """Editorial rules: abbreviations, unrecorded tube or serial, unknown QC body, administrative requests."""
    blanked = [
        "TIPO DE EQUIPO", "FECHA DE FABRICACIÓN", "MARCA", "MODELO", "SERIE", "MARCA TUBO RX", "MODELO TUBO RX",
        "SERIE TUBO RX", "FECHA FABRICACIÓN TUBO RX", "CONTROL CALIDAD", "FECHA CC",
    ]
    or_unrecorded = ["SERIE", "MARCA TUBO RX", "MODELO TUBO RX", "SERIE TUBO RX"]
    administrative = F.upper(py_trim(fields["TIPO DE SOLICITUD"])).isin(ADMINISTRATIVE_REQUESTS)

    def rule(k: Column, v: Column) -> Column:
        short = v
        for pattern, abbreviation in ABBREVIATIONS:
            short = F.regexp_replace(short, pattern, abbreviation)
        return (
            F.when(administrative & k.isin(blanked), F.lit(None).cast("string"))
            .when(k.isin(or_unrecorded) & blank(v), NOT_RECORDED)
            .when((k == "CONTROL CALIDAD") & ~F.coalesce(py_trim(short), F.lit("")).isin(QC_BODIES), UNKNOWN_QC_BODY)
            .otherwise(short)
        )

    return F.transform_values(fields, rule)


# --- extraction and its cache -------------------------------------------------------------

Extractor = Callable[[str, int], str]


def rule_extractor(text: str, attempt: int) -> str:
    """Offline default: ``LABEL: value`` lines; a line ``EQUIPO n`` starts the next piece of equipment."""
    header: dict[str, str] = {}
    equipment: list[dict[str, str]] = []
    for line in text.splitlines():
        label, colon, value = (part.strip() for part in line.partition(":"))
        if label.startswith("EQUIPO ") and not colon:
            equipment.append({})
        elif colon and label.isupper():
            (equipment[-1] if equipment else header)[label] = value
    return json.dumps({**header, "EQUIPOS": equipment}, ensure_ascii=False) if header or equipment else ""


def holds_json(raw: str) -> bool:
    """Whether a reply can be read at all: an object from its first brace on, trailing commas allowed."""
    text = raw.translate(str.maketrans("“”‘’", "\"\"''"))
    body = text[text.find("{"):] if "{" in text else ""
    for candidate in (body, re.sub(r",\s*([}\]])", r"\1", body)):
        try:
            return isinstance(json.JSONDecoder().raw_decode(candidate)[0], dict)
        except ValueError:
            continue
    return False


def extract_replies(documents: DataFrame, extractor: Extractor = rule_extractor, budget: int | None = None, last_budget: int | None = None) -> DataFrame:
    """Replace ``text`` by ``raw`` and ``extract_error``: the user's extractor in Arrow batches, up to three attempts.

    Whole texts go in, unless a caller whose extractor takes no more sets ``budget`` (and ``last_budget`` for the third attempt).
    The first reply that can be read ends the attempts. All other columns pass through.

    A document whose extractor raises or answers nothing gets a null reply and its reason, one whose replies cannot be
    read the last of them; neither stops the run.
    """

    def attempts(text: str) -> tuple[str | None, str | None]:
        last, reason = None, "no reply"
        for attempt in range(3):
            try:
                raw = extractor(text[: budget if attempt < 2 else last_budget], attempt)
            except Exception as error:  # noqa: BLE001
                reason = f"{type(error).__name__}: {error}"
                continue
            if holds_json(raw or ""):
                return raw, None
            last = raw if "{" in (raw or "") else last
        return last, None if last else reason

    kept = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [attempts(text or "") for text in batch.column("text").to_pylist()]
            found = [pa.array([a[i] for a in answers], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + found, names=[*kept, "raw", "extract_error"])

    schema = documents.select(*kept, F.lit("").cast("string").alias("raw"), F.lit("").cast("string").alias("extract_error")).schema
    return documents.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema]))


def cached_or_extracted(documents: DataFrame, cache: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """Cached licence per (number, file), and the extractor's for the rest.

    The anti-join stands before the extractor, so only misses pay for it.
    """
    keyed = documents.withColumn("cache_key", cache_key(F.col("radicado"), F.col("file_id"), F.col("name")))
    stored = cache.groupBy("cache_key").agg(F.max_by("licence", "stored_at").alias("licence"))  # one entry per key
    hits = keyed.join(stored, "cache_key").drop("text").withColumn("reason", F.lit(None).cast("string")).withColumn("from_cache", F.lit(True))
    misses = keyed.join(stored.select("cache_key"), "cache_key", "left_anti")
    fresh = (
        parse_replies(extract_replies(misses, extractor))
        .withColumn("reason", F.coalesce("extract_error", "reason")).withColumn("from_cache", F.lit(False))
    )
    return hits.unionByName(fresh.select(*hits.columns))


def cache_entries(licences: DataFrame, stamp: Column) -> DataFrame:
    """Normalised licences as cache rows; written also when they came from the cache."""
    whole = with_number(F.col("licence"), F.col("radicado"))
    return licences.filter(F.col("licence").isNotNull()).select(
        cache_key(F.col("radicado"), F.col("file_id"), F.col("file_name")).alias("cache_key"),
        F.map_concat(whole, F.create_map(F.lit("EQUIPOS"), F.to_json(equipment_list(whole)))).alias("licence"),
        stamp.alias("stored_at"),
    )


def newest_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two cache tables, newest entry per key (partial aggregation before the shuffle)."""
    return (
        old.unionByName(new).groupBy("cache_key")
        .agg(F.max_by("licence", "stored_at").alias("licence"), F.max("stored_at").alias("stored_at"))
    )


def without_cached_file(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """Only-new mode: files whose whole id has no cache entry yet."""
    seen = cache.select(id_of_cache_key(F.col("cache_key")).alias("_cached_id")).distinct()
    return manifest.join(seen, F.col("file_id") == F.col("_cached_id"), "left_anti")
