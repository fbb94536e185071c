"""Records that arrive as model output: JSON found in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx


def _parse(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else.

    The parser stops after the first value; text that also parses inside brackets and
    inside braces has nothing behind it.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(listed.isNotNull() & held.isNotNull(), F.try_parse_json(text))


def _object(text: Column) -> Column:
    value = _parse(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def extract_json(text: Column) -> Column:
    """VARIANT object: the whole string, else the outermost braces; objects only."""
    whole = tx.strip(text)
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    return F.when(_parse(whole).isNotNull(), _object(whole)).otherwise(_object(inner))


def extract_fenced_json(text: Column) -> Column:
    """As above for answers that fence their JSON as a code block."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(text.contains("```"), _object(fenced)).otherwise(
        _object(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    )


def string_field(payload: Column, name: str) -> Column:
    """Field as text; null when absent or empty."""
    value = F.try_variant_get(payload, f"$.{name}", "string")
    return F.when(F.length(value) > 0, value)


def list_field(payload: Column, name: str) -> Column:
    """Field as a list of strings; text is split at commas and blanks; empty means null."""
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{name}", "variant"))
    words = F.filter(
        F.split(F.try_variant_get(payload, f"$.{name}", "string"), f"[,，、{lx.SPACE_CLASS}]+"), lambda w: w != ""
    )
    value = (
        F.when(kind.startswith("ARRAY"), F.try_variant_get(payload, f"$.{name}", "array<string>"))
        .when(kind == "STRING", words)
    )
    return F.when(F.size(value) > 0, value)


def number_field(payload: Column, name: str, default: float) -> Column:
    text = F.try_variant_get(payload, f"$.{name}", "string")
    return F.coalesce(text.try_cast("double"), F.lit(default))


def flag_field(payload: Column, name: str) -> Column:
    """Truth of a field: text, lists and objects are true unless empty, numbers unless zero, null is false.

    Null only when the field is absent.
    """
    path = f"$.{name}"
    value = F.try_variant_get(payload, path, "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(payload, path, "string")
    present = F.array_contains(F.map_keys(F.try_variant_get(payload, "$", "map<string,variant>")), name)
    truth = (
        F.when(F.coalesce(F.is_variant_null(value), F.lit(True)), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(payload, path, "boolean"))
        .when(kind == "STRING", F.length(text) > 0)
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(value).isin("[]", "{}"))
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )
    return F.when(present, truth)


def aliased(value: Column, aliases: dict[str, str], allowed: list[str], default: Column | str) -> Column:
    """Alias lookup, then a whitelist."""
    table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    known = F.coalesce(F.try_element_at(table, value), value)
    return F.when(known.isin(allowed), known).otherwise(default if isinstance(default, Column) else F.lit(default))
