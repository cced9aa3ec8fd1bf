"""Text rules as Column expressions. All of them run on the JVM; none is a Python UDF."""

from __future__ import annotations

import unicodedata
from functools import reduce
from string import ascii_uppercase, digits

from pyspark.sql import Column, functions as F

# Every character a Unicode-aware strip() removes.
WHITESPACE = "".join(
    chr(cp) for cp in range(0x10000) if not 0xD800 <= cp < 0xE000 and chr(cp).isspace()
)
# Line boundaries of a Unicode-aware splitlines().
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
# All of them but the line feed; single characters, as ranges make a class slower.
_OTHER_BREAKS = r"[\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
ALNUM = r"[\p{L}\p{N}]"


def _accent_table() -> tuple[str, str]:
    """Precomposed characters of the BMP and their form without combining marks."""
    source, target = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        char = chr(cp)
        if unicodedata.category(char) == "Mn":
            continue
        decomposed = unicodedata.normalize("NFD", char)
        bare = "".join(c for c in decomposed if unicodedata.category(c) != "Mn")
        bare = unicodedata.normalize("NFC", bare)
        if bare != char and len(bare) == 1:
            source.append(char)
            target.append(bare)
    return "".join(source), "".join(target)


ACCENTED, BARE = _accent_table()


def py_trim(c: Column) -> Column:
    """Strip Unicode white space at both ends (plain ``trim`` only knows U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank(c: Column) -> Column:
    """Null, absent and white space only are one thing in the registry."""
    return F.coalesce(py_trim(c), F.lit("")) == ""


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nonblank(c: Column) -> Column:
    """The trimmed value, or null when it is blank; made for ``coalesce`` chains."""
    return F.nullif(py_trim(c), F.lit(""))


# Texts that stand for "nothing recorded".
PLACEHOLDERS = ["NO REGISTRA", "NO REGISTRADA", "NO APLICA"]


def placeholder_empty(c: Column) -> Column:
    """Blank, or one of the texts that stand for an unrecorded value."""
    trimmed = F.coalesce(py_trim(c), F.lit(""))
    return (trimmed == "") | F.upper(trimmed).isin(PLACEHOLDERS)


def strip_accents(c: Column) -> Column:
    """Drop combining marks, from composed letters and as separate characters.

    A text with as many bytes as characters is ASCII and has none; most are.
    """
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), ACCENTED, BARE))


# All but capitals and digits; single characters, as ranges make a class slower.
_NO_KEY = f"[^{ascii_uppercase}{digits}]+"


def label_key(c: Column) -> Column:
    """Form in which labels are compared: no accents, upper case, single spaces."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), _NO_KEY, " "))


def value_key(c: Column) -> Column:
    """Form in which values are stored: trimmed, upper case, accents kept."""
    return F.upper(py_trim(c))


def placeholder_key(c: Column) -> Column:
    """Form in which template markers are compared."""
    return F.btrim(F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z0-9]+", "_"), F.lit("_"))


def lines(c: Column, limit: int = -1) -> Column:
    """Lines of a text (a plain column): cut at the one character that is their only break in most texts, else by the regex."""
    return F.when(c.rlike(_OTHER_BREAKS), F.split(c, LINE_BREAK, limit)).otherwise(F.split(c, "\n", limit))


def head_lines(c: Column, n: int) -> Column:
    """First ``n`` lines; the split stops there, so long texts are not cut up whole."""
    return F.slice(lines(c, n + 1), 1, n)


# --- filing numbers and names -------------------------------------------------------------

# Where a filing number is looked for.
NUMBER_IN_NAME = r"([0-9]{6,})"
NUMBER_AFTER_WORD = r"(?iU)\bradicado\b[:\s\-#]*([0-9]{6,})"
NUMBER_AT_LINE_START = r"(?mU)^\s*([0-9]{6,})\b"


def _first_group(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def filing_number_from_name(name: Column) -> Column:
    return _first_group(name, NUMBER_IN_NAME)


def filing_number_from_text(text: Column, first_lines: int | None = None) -> Column:
    """Number after its word, else at the start of a line; in the whole text unless ``first_lines`` limits it."""
    head = text if first_lines is None else F.array_join(head_lines(text, first_lines), "\n")
    return F.coalesce(_first_group(head, NUMBER_AFTER_WORD), _first_group(head, NUMBER_AT_LINE_START))


def filing_number(name: Column, text: Column, first_lines: int | None = None) -> Column:
    """File name first, then the text; null when neither has a number."""
    return F.coalesce(filing_number_from_name(name), filing_number_from_text(text, first_lines))


def id_of_cache_key(key: Column) -> Column:
    """File id (or stem) of a cache key: all that follows its number."""
    return F.regexp_extract(key, r"(?s)\A.*?__(.*)\z", 1)


def cache_key(number: Column, file_id: Column, name: Column) -> Column:
    """Key of a stored extraction: number + whole file id, or the whole safe file stem without an id."""
    stem = file_stem(name)
    safe = F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")
    suffix = F.coalesce(
        F.nullif(file_id, F.lit("")),
        F.nullif(safe, F.lit("")),
        F.lit("local"),
    )
    return F.concat(number, F.lit("__"), suffix)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(file_name(F.coalesce(path, F.lit(""))), r"(?<=[^.])\.[^.]*$", "")


def report_identifier(path: Column) -> Column:
    """All-digit part of the stem before its first underscore, else an empty text."""
    return F.regexp_extract(file_stem(path), r"^([0-9]+)(?:_|$)", 1)


def output_name(source_name: Column, number: Column, suffix: Column | None = None) -> Column:
    """Name of a rendered licence derived from the checklist it came from."""
    stem = file_stem(source_name)
    parts = F.split(stem, "_")
    named = F.when(
        F.size(parts) >= 3,
        F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "_"), F.lit("_LICENCIA")),
    ).otherwise(F.concat(stem, F.lit("_LICENCIA")))
    tail = F.regexp_replace(named, "^[^_]*_", "")
    name = F.concat(value_key(number), F.lit("_"), tail)
    if suffix is None:
        return name
    key = F.coalesce(placeholder_key(suffix), F.lit(""))
    return F.concat(name, F.when(key != "", F.concat(F.lit("_"), key)).otherwise(""))


# --- enumerations -------------------------------------------------------------------------

# Applicant types and licence categories.
PERSON_NATURAL = "PERSONA NATURAL"
PERSON_LEGAL = "PERSONA JURIDICA"
CATEGORY_1 = "CATEGORIA 1"
CATEGORY_2 = "CATEGORIA 2"


def applicant_type(c: Column) -> Column:
    key = label_key(F.coalesce(c, F.lit("")))
    return (
        F.when(key == PERSON_NATURAL, PERSON_NATURAL)
        .when(key == PERSON_LEGAL, PERSON_LEGAL)
        .when(key.contains("NAT"), PERSON_NATURAL)
        .when(key.contains("JUR"), PERSON_LEGAL)
    )


def licence_category(c: Column, roman_i: bool = False) -> Column:
    """Category named by a text; ``roman_i`` also reads a lone Roman numeral I."""
    key = label_key(F.coalesce(c, F.lit("")))
    has_cat = key.contains("CAT")
    chain = (
        F.when(key.contains("1") & has_cat, CATEGORY_1)
        .when(key.contains("II") | (key.contains("2") & has_cat), CATEGORY_2)
        .when(key.contains("PERIAP"), CATEGORY_1)
        .when(key.contains("PANOR") | key.contains("TOMOG"), CATEGORY_2)
    )
    return chain.when(key.rlike(r"(^| )I( |$)"), CATEGORY_1) if roman_i else chain


def first_category(*texts: Column) -> Column:
    """First text, in order, that names a category."""
    return F.coalesce(*[licence_category(t) for t in texts])


def email(c: Column) -> Column:
    return F.lower(py_trim(c))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, pair: F.regexp_replace(acc, pair[0], pair[1]), pairs, c)
