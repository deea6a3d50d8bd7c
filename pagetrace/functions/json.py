"""Strict reading of JSON kept in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """Variant of a whole JSON document, NULL when anything follows it.

    The parser stops after the first document, so ``[1]]`` would pass; inside an
    object with a second key the leftovers become a syntax error or extra keys.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('{"document":'), text, F.lit(',"end":1}')))
    members = F.try_variant_get(wrapped, "$", "map<string,variant>")
    complete = (F.size(members) == 2) & F.try_variant_get(wrapped, "$.end", "int").isNotNull()
    return F.when(complete, F.try_variant_get(wrapped, "$.document", "variant"))


def kind(value: Column) -> Column:
    """JSON kind of a variant (OBJECT.., ARRAY.., STRING, BIGINT, BOOLEAN ...), empty for none."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def json_list(text: Column) -> Column:
    """array<variant> of a JSON list; NULL for anything else."""
    parsed = strict_json(text)
    return F.when(kind(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))


def positive_int(item: Column, field: str) -> Column:
    """The field when it is a JSON integer above zero; booleans and strings do not count."""
    path = f"$.{field}"
    number = F.try_variant_get(item, path, "long")
    whole = kind(F.try_variant_get(item, path, "variant")) == "BIGINT"
    return F.when(whole & (number > 0), number)


def text_field(item: Column, field: str) -> Column:
    path = f"$.{field}"
    return F.when(
        kind(F.try_variant_get(item, path, "variant")) == "STRING", F.try_variant_get(item, path, "string")
    )


def true_field(item: Column, field: str) -> Column:
    """True only for a JSON ``true``."""
    path = f"$.{field}"
    value = F.when(
        kind(F.try_variant_get(item, path, "variant")) == "BOOLEAN", F.try_variant_get(item, path, "boolean")
    )
    return F.coalesce(value, F.lit(False))


def number_field(item: Column, field: str) -> Column:
    path = f"$.{field}"
    numeric = kind(F.try_variant_get(item, path, "variant")).rlike("^(DECIMAL|BIGINT|DOUBLE|FLOAT)")
    return F.when(numeric, F.try_variant_get(item, path, "double"))
