"""Schemas and fixed enumerations of edges and their relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("ts", T.LongType(), False),
    T.StructField("relation", T.IntegerType(), False), T.StructField("weight", T.FloatType(), True), T.StructField("seq", T.LongType(), False),
])

# --- fixed values: codes that graphs of filings and chains are written with ---
RELATIONS = {
    "UNKNOWN": 0, "SUPPLIES_TO": 1, "OWNS": 2, "COMPETES_WITH": 3, "PARTNERS_WITH": 4, "LENDS_TO": 5,
    "EARNINGS_EVENT": 10, "LEADERSHIP_CHANGE": 11, "DEAL_EVENT": 12, "LEGAL_EVENT": 13, "INTERLOCK": 20, "SUPPLY": 21,
}
STRUCTURAL = ("SUPPLIES_TO", "OWNS", "COMPETES_WITH", "PARTNERS_WITH", "LENDS_TO")
SOURCES = {"text_8k": 0, "interlock": 1, "supply_chain": 2, "comovement": 3}
SIGNS = {"NEGATIVE": -1, "NEUTRAL": 0, "POSITIVE": 1}
MAGNITUDES = {"NEGLIGIBLE": 0.1, "SMALL": 0.3, "MODERATE": 1.0, "LARGE": 3.0}
CONFIDENCES = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
CHAIN_RELATIONS = {"UNKNOWN": 0, "VALUE_TRANSFER": 1, "CALL": 2, "ZERO_CALL": 3, "CREATE": 4, "FAILED": 5}
CONFLICT, COOPERATION = (3, 4), (1, 2)
RELATION_BITS, CONFIDENCE_SHIFT, SOURCE_SHIFT = 0xFF, 8, 11


def pack_relation(kind: Column, confidence: Column, source: Column | None = None) -> Column:
    """Bits 0-7 the type, 8-9 the confidence, 11-13 the source."""
    code = kind.bitwiseAND(RELATION_BITS).bitwiseOR(F.shiftleft(confidence.bitwiseAND(3), CONFIDENCE_SHIFT))
    return code if source is None else code.bitwiseOR(F.shiftleft(source.bitwiseAND(7), SOURCE_SHIFT))


def unpack_relation(code: Column) -> tuple[Column, Column, Column]:
    """(type, confidence, source)."""
    return code.bitwiseAND(RELATION_BITS), F.shiftright(code, CONFIDENCE_SHIFT).bitwiseAND(3), F.shiftright(code, SOURCE_SHIFT).bitwiseAND(7)


def edge_weight(sign: Column, magnitude: Column) -> Column:
    """Signed magnitude; unknown names weigh 0."""
    scale = F.create_map(*[x for k, v in MAGNITUDES.items() for x in (F.lit(k), F.lit(v))])
    side = F.create_map(*[x for k, v in SIGNS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(side, F.upper(sign)) * F.try_element_at(scale, F.upper(magnitude)), F.lit(0.0))
