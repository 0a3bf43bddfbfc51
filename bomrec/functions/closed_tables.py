"""Closed tables every run must agree on.

Fixed values: names, qualities, standards, finishes, materials, derivations, provenance scores,
reasons, policies and the word lists of the multiplicity rule.
"""

from __future__ import annotations

# Fixed values, all of this module: results are only comparable when they are equal everywhere.

ATTRIBUTES = ("name", "material", "quality", "measure", "length", "standard", "finish")
GRADED_CELLS = (*ATTRIBUTES, "quantity")

# name -> (client aliases, added aliases)
NAME_ALIASES = {
    "VARILLA ROSCADA": (("THREADED ROD", "VARILLA ROSCADA"), ("BARRA ROSCADA", "TIGE FILETEE")),
    "ESPARRAGO": (("STUD BOLT", "STUD", "ESPARRAGO"), ("ESPARRAGOS", "PRISIONERO")),
    "TORNILLO": (
        ("SCREW", "BOLT", "TORNILLO"),
        ("TORNILLOS", "HEX BOLT", "HEX HD BOLT", "VIS", "PARAFUSO", "SCHRAUBE"),
    ),
    "TUERCA": (("NUT", "TUERCA"), ("TUERCAS", "ECROU", "PORCA", "MUTTER")),
    "ARANDELA": (("WASHER", "ARANDELA"), ("ARANDELAS", "RONDELLE", "ARRUELA", "SCHEIBE")),
}
LENGTH_EXEMPT = ("TUERCA", "ARANDELA")

MATERIAL_ALIASES = {
    "AC": (("ACERO", "STEEL", "AC"), ("ACERO AL CARBONO", "CARBON STEEL", "ACIER", "ACO")),
    "INOX": (("INOX",), ("ACERO INOXIDABLE", "STAINLESS", "STAINLESS STEEL", "INOXIDABLE")),
}

QUALITY_GROUPS = {
    "G1": ("A2", "A2-70", "18-8", "304"),
    "G2": ("A2-80",),
    "G3": ("A4", "A4-70", "316"),
    "G4": ("A4-80",),
    "G5": ("8.8", "GRADE 5", "GRADO 5"),
    "G6": ("10.9", "GRADE 8", "GRADO 8"),
    "G7": ("12.9",),
    "G8": ("8",),
    "G9": ("10",),
    "G10": ("100HV",),
    "G11": ("140HV",),
    "G12": ("160HV",),
    "G13": ("200HV",),
    "G14": ("300HV",),
}
NUT_ONLY_GROUPS = ("G8", "G9")
BOLT_ONLY_GROUPS = ("G5", "G6", "G7")
HARDNESS_GROUPS = ("G10", "G11", "G12", "G13", "G14")

GRADE_SCAN = "\\bGR\\.?\\s?(?:[A-Z]\\s?\\d+[A-Z]?|\\d+[A-Z]?)\\b"
KNOWN_GRADE = "(?i)^(GR\\.?\\s*)?(B7M?|B16|B8M?|2HM?|2H|4|7|L7|L43|8M?|8[ACM]?)$"

STANDARD_EQUIVALENCES = {
    "DIN 84": "ISO 1207",
    "DIN 440": "ISO 7094",
    "DIN 603": "ISO 8677",
    "DIN 912": "ISO 4762",
    "DIN 913": "ISO 4026",
    "DIN 916": "ISO 4029",
    "DIN 931": "ISO 4014",
    "DIN 933": "ISO 4017",
    "DIN 934": "ISO 4032",
    "DIN 935": "ISO 7035",
    "DIN 936": "ISO 4035",
    "DIN 960": "ISO 8765",
    "DIN 961": "ISO 1665",
    "DIN 963": "ISO 2009",
    "DIN 965": "ISO 7046",
    "DIN 980": "ISO 7042",
    "DIN 982": "ISO 7040",
    "DIN 985": "ISO 10511",
    "DIN 6923": "EN 1661",
    "DIN 7981 C-H": "ISO 7049",
    "DIN 7982 C-H": "ISO 7050",
    "DIN 7985": "ISO 7045",
    "DIN 7991": "ISO 10642",
    "DIN 9021": "ISO 7093",
    "DIN 125": "ISO 7089",
    "DIN 125 A": "ISO 7089",
}
# family -> (pattern, prefix of the canonical designation); earlier families are tried first
STANDARD_PATTERNS = {
    "DIN EN": ("\\bDIN\\s*EN\\s*([0-9]+(?:-[0-9]+)?)\\b", "DIN EN "),
    "MSS SP": ("\\bMSS\\s*SP\\s*[- ]\\s*([0-9]+)\\b", "MSS SP-"),
    "DIN": ("\\bDIN\\s*([0-9]+)(?:\\s+([A-Z](?:\\s*-\\s*[A-Z])?))?\\b", "DIN "),
    "ISO": ("\\bISO\\s*([0-9]+)\\b", "ISO "),
    "ASTM": ("\\bASTM\\s*([A-Z]\\s*[0-9]+)\\b", "ASTM "),
    "ASME": ("\\bASME\\s*(B\\s*[0-9]+(?:\\.[0-9]+)*[A-Z]?)\\b", "ASME "),
    "EN": ("\\bEN\\s*([0-9]+)\\b", "EN "),
}

FINISH_CATALOG = (
    "GEOMET", "DACROMET", "GALVANIZADO EN CALIENTE", "CINCADO", "PAVONADO", "FOSFATADO", "BICROMATADO",
)
# finish -> (id stem, client aliases, added aliases)
FINISH_ALIASES = {
    "GEOMET": ("geomet", ("GEOMET",), ()),
    "DACROMET": ("dacromet", ("DACROMET",), ()),
    "GALVANIZADO EN CALIENTE": (
        "galvanizado",
        ("GALVANIZADO EN CALIENTE", "HOT DIP GALVANIZED", "GALVA", "HDG"),
        ("GALVANIZADA EN CALIENTE", "HOT DIP GALV", "GALVANIZED"),
    ),
    "CINCADO": (
        "cincado",
        ("CINCADO", "ZINCADO", "ZN", "ZP", "ZINC PLATED"),
        ("CINCADA", "ZINCADA", "ZINCADOS", "ZINCADAS", "ZINGUE", "GALV ELECTROLITICO"),
    ),
    "PAVONADO": ("pavonado", ("PAVONADO", "BL", "NEGRO"), ("PAVONADA", "BLACK", "NOIR")),
    "FOSFATADO": ("fosfatado", ("FOSFATADO", "PHOSPHATED"), ("FOSFATADA", "PHOSPHATE")),
    "BICROMATADO": (
        "bicromatado",
        ("BICROMATADO", "YZP", "YELLOW ZINC PLATED"),
        ("BICROMATADA", "ZINC AMARILLO"),
    ),
}

# (entry id, match kind, match value, material)
MATERIAL_DERIVATIONS = (
    ("inox-a2", "group", "G1", "INOX"),
    ("inox-a2-80", "group", "G2", "INOX"),
    ("inox-a4", "group", "G3", "INOX"),
    ("inox-a4-80", "group", "G4", "INOX"),
    ("ac-clase-8-8", "group", "G5", "AC"),
    ("ac-clase-10-9", "group", "G6", "AC"),
    ("ac-clase-12-9", "group", "G7", "AC"),
    ("ac-tuerca-8", "group", "G8", "AC"),
    ("ac-tuerca-10", "group", "G9", "AC"),
    ("ac-astm-b7", "pattern", "^(GR\\.?\\s*)?B7M?$", "AC"),
    ("ac-astm-2h", "pattern", "^(GR\\.?\\s*)?2HM?$", "AC"),
    ("ac-astm-b16", "pattern", "^(GR\\.?\\s*)?B16$", "AC"),
    ("ac-tuerca-45h", "pattern", "^45H$", "AC"),
)
# (match kind, match value): declared not derivable
MATERIAL_UNCOVERED = tuple(("group", g) for g in HARDNESS_GROUPS)

PROVENANCE_SCORE = {
    "exact_catalog": 1.0,
    "extracted": 0.95,
    "table_normalized": 0.95,
    "extracted_uncatalogued": 0.8,
    "extrapolated": 0.7,
    "derived": 0.55,
    "inferred": 0.45,
    "human_corrected": 1.0,
}
# strong to weak
PROVENANCE_ORDER = (
    "human_corrected", "exact_catalog", "table_normalized", "extracted", "extracted_uncatalogued",
    "extrapolated", "derived", "inferred", "absent",
)
MARKED_PROVENANCE = ("human_corrected", "extrapolated", "derived", "inferred", "extracted_uncatalogued")
WEAK_PROVENANCE = ("inferred", "derived", "extracted_uncatalogued")

REASON_KINDS = {
    "QUALITY_MISSING": "MISSING_IN_SOURCE",
    "STANDARD_MISSING": "MISSING_IN_SOURCE",
    "MEASURE_MISSING": "MISSING_IN_SOURCE",
    "LENGTH_MISSING": "MISSING_IN_SOURCE",
    "NAME_MISSING": "MISSING_IN_SOURCE",
    "QUANTITY_NOT_STATED": "MISSING_IN_SOURCE",
    "OUT_OF_FAMILY": "OUT_OF_SCOPE",
    "EMPTY_DESCRIPTION": "MISSING_IN_SOURCE",
    "PROCESSING_FAILED": "LOW_CONFIDENCE",
    "FINISH_SCOPE_UNSTATED": "MISSING_IN_SOURCE",
    "NO_ELEMENTS_EXTRACTED": "LOW_CONFIDENCE",
    "QUALITY_TYPE_INCOHERENCE": "INCOHERENCE",
    "UNIT_MISMATCH": "INCOHERENCE",
    "LENGTH_UNIT_IMPLAUSIBLE": "INCOHERENCE",
    "LOW_CONFIDENCE": "LOW_CONFIDENCE",
    "CRITIC_DISAGREES": "LOW_CONFIDENCE",
    "UNMAPPED_VALUE": "LOW_CONFIDENCE",
}

# policy -> admitted values, the default first
POLICIES = {
    "finish_set_scope": ("review", "whole_set", "principal_only"),
    "implicit_multiplicity": ("infer_one", "review"),
    "material_derivation": ("from_quality", "off"),
    "unitless_length": ("plausibility_range", "review"),
    "missing_standard": ("review", "resolve"),
    "quality_coherence": ("review", "ignore"),
    "hv_scope": ("anywhere", "washer_only"),
    "out_of_family": ("review", "silent_skip"),
    "bare_measure_in_set": ("reject", "keep"),
    "rejected_measure_as_quality": ("if_catalog_and_coherent", "off"),
    "unknown_finish": ("review", "resolve"),
    "uncovered_material": ("review", "resolve"),
}

# Multiplicity: words between a count and its name, words that introduce a count, window size
COUNT_QUALIFIERS = (
    "HEX", "HEXAGONAL", "HEXAGONALES", "PLANA", "PLANAS", "PLANO", "PLANOS", "AUTOBLOCANTE",
    "AUTOBLOCANTES", "ALLEN", "CILINDRICO", "CILINDRICOS", "FLAT", "LOCK", "SPRING", "HEAVY", "HVY",
)
COUNT_CONNECTORS = ("W", "C/W", "CW", "CON", "CONJUNTO", "WITH", "AND", "Y", "MAS", "PLUS")
COUNT_WINDOW = 26

# Sheet ingestion
CELL_SEPARATOR = " | "
MIN_HEADER_CELLS = 3
QUANTITY_HEADERS = ("CANTIDAD", "CANT", "QUANTITY", "QUANTITE", "QUANT", "QTY", "NOS", "UDS")
UNIT_HEADERS = ("UD", "UNIDAD", "UNIT", "UNITE", "UM", "UOM")
ITEM_HEADER = "(?iu)^ITEM|^POS|^REF|^L[I\u00cd]NEA|^N[\u00bao\u00b0]"

# KPI constants
LIFECYCLE_EVENTS = (
    "revision_opened", "review_closed", "rfq_sent", "order_placed", "supplier_confirmed", "delivered",
)
LIFECYCLE_STAGES = {
    "review_time": ("revision_opened", "review_closed"),
    "rfq_to_order": ("rfq_sent", "order_placed"),
    "order_to_confirmation": ("order_placed", "supplier_confirmed"),
    "order_to_delivery": ("order_placed", "delivered"),
    "rfq_to_delivery": ("rfq_sent", "delivered"),
}
CORRECTION_TARGET_SECONDS = 90
PROJECT_ROWS_READ = 500_000
MANUAL_PROJECT_HOURS = 2_500
LOWER_IS_BETTER = ("silent_error_rate", "queue_noise", "cost_eur", "latency_ms")
