"""Field catalogue and label dictionaries of checklists and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fichero.functions.text import ACCENTED, BARE

# Required fields (key, label) checked for the document and for each equipment.
REQUIRED_DOCUMENT = [
    ("TIPO_SOLICITANTE", "Tipo de solicitante"),
    ("CATEGORIA", "Categoría de licencia"),
    ("NOMBRE_SOLICITANTE", "Nombre o razón social"),
    ("NIT_CC", "NIT o C.C."),
    ("SEDE", "Nombre de la sede"),
    ("DIRECCION", "Dirección del establecimiento"),
    ("OPR_NOMBRE", "Encargado/OPR nombre completo"),
    ("OPR_CC", "C.C. Encargado/OPR"),
]
REQUIRED_EQUIPMENT = [
    ("TIPO_DE_EQUIPO", "Tipo de equipo"),
    ("RADICADO_EQUIPO", "Radicado del equipo"),
]

# The fields that describe one piece of equipment.
EQUIPMENT_FIELDS = [
    "TIPO_DE_EQUIPO", "CATEGORIA_EQUIPO", "RADICADO", "FECHA_RADICACION", "RADICADO_EQUIPO",
    "RESOLUCION", "FECHA_RESOLUCION", "DIA_EMISION", "MES_EMISION", "ANO_EMISION",
    "RESOLUCION_EQUIPO", "FECHA_RESOLUCION_EQUIPO", "PRACTICA", "MARCA", "MODELO", "SERIE",
    "FECHA_FABRICACION", "MARCA_TUBO", "MODELO_TUBO", "SERIE_TUBO", "FECHA_FABRICACION_TUBO",
    "KV", "MA", "W", "UBICACION_EQUIPO", "EMPRESA_QC", "FECHA_QC",
]
TUBE_FIELDS = ["MARCA_TUBO", "MODELO_TUBO", "SERIE_TUBO"]

# Document-level fields a checklist can hold besides the equipment fields.
DOCUMENT_FIELDS = [
    "TIPO_SOLICITANTE", "CATEGORIA", "NOMBRE_SOLICITANTE", "NIT_CC", "REPRESENTANTE_LEGAL",
    "REPRESENTANTE_CC", "SEDE", "DIRECCION", "MUNICIPIO", "SUBREGION", "TIPO_DE_SOLICITUD",
    "EMAIL_NOTIFICACION", "FECHA_HOY", "OPR_NOMBRE", "OPR_CC", "OBSERVACIONES",
]

# Labels of every field, in comparison form (accents dropped, punctuation to space).
GENERAL_LABELS = {
    "RADICADO": ["RADICADO", "NO RADICADO", "NUMERO DE RADICADO"],
    "TIPO_SOLICITANTE": ["TIPO DE SOLICITANTE", "SOLICITANTE", "TIPO PERSONA SOLICITANTE"],
    "NOMBRE_SOLICITANTE": ["NOMBRE O RAZON SOCIAL", "NOMBRE O RAZON SOCIAL DEL SOLICITANTE", "RAZON SOCIAL", "NOMBRE COMPLETO"],
    "RADICADO_EQUIPO": ["RADICADO EQUIPO", "RADICADO DEL EQUIPO", "RADICADO E"],
    "NIT_CC": ["NIT", "NIT O CC", "NIT O C C", "NIT CC", "NIT O CEDULA", "CEDULA", "C C", "CC"],
    "REPRESENTANTE_LEGAL": ["REPRESENTANTE LEGAL", "NOMBRE REPRESENTANTE LEGAL", "NOMBRE COMPLETO REPRESENTANTE LEGAL"],
    "REPRESENTANTE_CC": [
        "DOCUMENTO REPRESENTANTE LEGAL", "CC REPRESENTANTE", "CC REPRESENTANTE LEGAL", "CC R", "CC DEL REPRESENTANTE LEGAL",
        "CEDULA REPRESENTANTE LEGAL",
    ],
    "SEDE": ["NOMBRE SEDE", "SEDE", "NOMBRE SEDE O CONSULTORIO", "NOMBRE DEL ESTABLECIMIENTO"],
    "DIRECCION": ["DIRECCION", "DIRECCION ESTABLECIMIENTO"],
    "MUNICIPIO": ["MUNICIPIO"],
    "SUBREGION": ["SUBREGION"],
    "TIPO_DE_SOLICITUD": ["TIPO DE SOLICITUD"],
    "EMAIL_NOTIFICACION": ["EMAIL NOTIFICACION"],
    "TIPO_DE_EQUIPO": ["TIPO DE EQUIPO"],
    "PRACTICA": ["PRACTICA", "PRACTICA SOLICITADA"],
    "CATEGORIA": ["CATEGORIA", "CATEGORIA LICENCIA", "CATEGORIA DEL EQUIPO"],
    "CATEGORIA_EQUIPO": ["CATEGORIA EQUIPO", "CATEGORIA E", "CATEGORIA DEL EQUIPO LICENCIA"],
    "MARCA": ["MARCA", "MARCA E"],
    "MODELO": ["MODELO", "MODELO E"],
    "SERIE": ["SERIE", "SERIE E", "NUMERO DE SERIE", "NUMERO SERIE", "NRO DE SERIE", "NRO SERIE", "N SERIE"],
    "KV": ["KV", "K V"],
    "MA": ["MA", "M A"],
    "W": ["W", "POTENCIA", "CARGA DE TRABAJO", "CARGA TRABAJO"],
    "FECHA_FABRICACION": ["FECHA DE FABRICACION", "FECHA FABRICACION E"],
    "MARCA_TUBO": ["MARCA TUBO RX", "MARCA T"],
    "MODELO_TUBO": ["MODELO TUBO RX", "MODELO T"],
    "SERIE_TUBO": ["SERIE TUBO RX", "SERIE T"],
    "FECHA_FABRICACION_TUBO": ["FECHA FABRICACION TUBO RX", "FECHA FABRICACION T"],
    "FECHA_QC": ["FECHA CC", "FECHA CONTROL CALIDAD", "FECHA DEL CONTROL DE CALIDAD", "FECHA QUE SE REALIZO EL CONTROL DE CALIDAD"],
    "OPR_NOMBRE": [
        "OFICIAL DE PROTECCION RADIOLOGICA", "ENCARGADO PROTECCION RADIOLOGICA", "ENCARGADO OPR NOMBRE COMPLETO",
        "ENCARGADO OPR", "NOMBRE ENCARGADO OPR", "NOMBRE ENCARGADO", "ENCARGADO OFICIAL DE PROTECCION RADIOLOGICA",
        "OFICIAL DE PROTECCION RADIOLOGICA NOMBRE", "OPR NOMBRE",
    ],
    "OPR_CC": [
        "DOCUMENTO OPR", "CC OPR", "CEDULA OPR", "CEDULA DEL OPR", "CEDULA ENCARGADO OPR", "CEDULA ENCARGADO",
        "CEDULA DEL ENCARGADO", "CC ENCARGADO", "CC DEL ENCARGADO",
    ],
    "UBICACION_EQUIPO": ["UBICACION", "UBICACION E"],
    "FECHA_RADICACION": ["FECHA RADICACION", "FECHA RADICACION EQUIPO", "FECHA RADICACION E"],
    "RESOLUCION": ["RESOLUCION", "NUMERO DE RESOLUCION"],
    "RESOLUCION_EQUIPO": ["RESOLUCION E", "RESOLUCION EQUIPO", "RESOLUCION DEL EQUIPO", "RESOLUCION EQUIPO LICENCIA"],
    "FECHA_RESOLUCION": ["FECHA RESOLUCION", "FECHA DE LA RESOLUCION"],
    "FECHA_RESOLUCION_EQUIPO": ["FECHA RESOLUCION EQUIPO", "FECHA RESOLUCION E", "FECHA RESOLUCION DEL EQUIPO"],
    "FECHA_HOY": ["FECHA HOY"],
    "DIA_EMISION": ["DIA EMISION", "DIA"],
    "MES_EMISION": ["MES EMISION", "MES"],
    "ANO_EMISION": ["ANO EMISION", "ANO"],
    "OBSERVACIONES": ["OBSERVACIONES", "COMENTARIOS"],
    "EMPRESA_QC": ["EMPRESA CONTROL CALIDAD", "EMPRESA CONTROL DE CALIDAD", "EMPRESA QUE REALIZO EL CONTROL DE CALIDAD"],
}

QC_SECTION_LABELS = {
    "EMPRESA_QC": ["EMPRESA", "EMPRESA DEL CC", "EMPRESA CC", "EMPRESA QC", "EMPRESA QUE REALIZA CC", "EMPRESA CONTROL CALIDAD"],
    "FECHA_QC": ["FECHA", "FECHA CC", "FECHA QC", "FECHA CONTROL CALIDAD"],
}
EQUIPMENT_SECTION = "EQUIPOS A LICENCIAR"

# Labels that mean something else inside a section.
SECTION_LABELS = {
    "CONTROL DE CALIDAD": QC_SECTION_LABELS,
    "INFORMACION CONTROL CALIDAD": QC_SECTION_LABELS,
    EQUIPMENT_SECTION: {
        "CATEGORIA_EQUIPO": ["CATEGORIA", "CATEGORIA EQUIPO", "CATEGORIA E"],
        "RADICADO_EQUIPO": ["RADICADO", "RADICADO E", "RADICADO EQUIPO", "RADICADO DEL EQUIPO"],
        "FECHA_RADICACION": ["FECHA RADICACION", "FECHA RADICACION EQUIPO", "FECHA RADICACION DEL EQUIPO", "FECHA RADICACION E"],
        "KV": ["KV", "K V"],
        "MA": ["MA", "M A"],
        "W": ["W", "POTENCIA", "CARGA DE TRABAJO", "CARGA TRABAJO"],
        "RESOLUCION_EQUIPO": ["RESOLUCION", "RESOLUCION EQUIPO", "RESOLUCION DEL EQUIPO"],
        "FECHA_RESOLUCION_EQUIPO": ["FECHA RESOLUCION", "FECHA RESOLUCION EQUIPO"],
    },
}

# Beginnings that make a cell look like a label.
LABEL_HINTS = [
    "RADIC", "FECHA", "CATEG", "RESOL", "SOLICIT", "REPRESENT", "NIT", "CEDULA", "DIREC", "MUNIC",
    "SUBREG", "SEDE", "EQUIPO", "MARCA", "MODELO", "SERIE", "TUBO", "CONTROL", "EMPRES", "QC", "OPR", "OBSERV",
]

# Labels of quality reports, accents dropped, in the order in which a line is tried.
QC_LABELS = {
    "FECHA DE LA VISITA": "fecha_evaluacion",
    "FECHA VISITA": "fecha_evaluacion",
    "FECHA DE VISITA": "fecha_evaluacion",
    "FECHA DE LA EVALUACION": "fecha_evaluacion",
    "FECHA DE EVALUACION": "fecha_evaluacion",
    "FECHA EVALUACION": "fecha_evaluacion",
    "TIPO DE EQUIPO": "tipo_equipo",
    "TIPO EQUIPO": "tipo_equipo",
    "TIPO DE EQUIPO EVALUADO": "tipo_equipo",
    "TIPO EQUIPO EVALUADO": "tipo_equipo",
    "EQUIPO EVALUADO": "tipo_equipo",
    "NOMBRE DE LA INSTITUCION": "nombre_institucion",
    "NOMBRE INSTITUCION": "nombre_institucion",
}
QC_FIELDS = {
    "fecha_evaluacion": "fecha de la evaluación",
    "tipo_equipo": "tipo de equipo",
    "nombre_institucion": "nombre de la institución",
}


def _pairs(groups: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(label, field) for field, labels in groups.items() for label in labels]


def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs for part in pair])


def label_table(spark: SparkSession) -> DataFrame:
    """Dictionaries as a dimension (section, label_norm, field); section '' is the general one."""
    rows = [("", label, field) for label, field in _pairs(GENERAL_LABELS)]
    for section, groups in SECTION_LABELS.items():
        rows += [(section, label, field) for label, field in _pairs(groups)]
    return spark.createDataFrame(rows, "section string, label_norm string, field string")


def general_field(label: Column) -> Column:
    """Field of a label in the general dictionary, as a lookup in a literal map."""
    return F.element_at(literal_map(_pairs(GENERAL_LABELS)), label)


def is_general_label(label: Column) -> Column:
    """Whether the general dictionary has a label; a set is searched faster than a map."""
    return label.isin([name for name, _ in _pairs(GENERAL_LABELS)])


def field_of(label: Column, section: Column) -> Column:
    """Field of a label: the section's dictionary first, then the general one."""
    in_section = F.lit(None).cast("string")
    for name, groups in SECTION_LABELS.items():
        in_section = F.when(section == name, F.element_at(literal_map(_pairs(groups)), label)).otherwise(in_section)
    return F.coalesce(in_section, general_field(label))


# The first combining mark of Unicode.
_FIRST_MARK = 0x300


def accent_insensitive(label: str, limit: int = 0x10000) -> str:
    """Regex for a label that also accepts accented forms of its letters, below ``limit``."""
    marks = r"\p{Mn}*" if limit > _FIRST_MARK else ""
    return "".join(f"{letter_class(char, limit)}{marks}" if char.isalpha() else char for char in label)


def letter_class(letters: str, limit: int) -> str:
    """Regex class of some capitals in both cases and with accents, below ``limit``."""
    variants = "".join(a for a, b in zip(ACCENTED, BARE) if b.upper() in letters and ord(a) < limit)
    return f"[{letters}{letters.lower()}{variants}]"
