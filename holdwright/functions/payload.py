"""Raw payloads of any stored shape as tagged entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRIES = "array<struct<source_row_number:int,payload:array<string>>>"


def tagged_entries(payload_json: Column, row_number: Column, attached: Column) -> Column:
    """Entries (source_row_number, payload) from stored JSON.

    Shapes: a list of texts (one record), a list of records whose numbers are
    the row and its attached rows in order, or entries tagged already. An entry
    without a number belongs to the row itself.
    """
    row = row_number.cast("int")
    tagged = F.from_json(payload_json, ENTRIES)
    lists = F.from_json(payload_json, "array<array<string>>")
    texts = F.from_json(payload_json, "array<string>")
    numbers = F.concat(F.array(row), F.coalesce(attached.cast("array<int>"), F.array().cast("array<int>")))
    entry = lambda number, payload: F.struct(number.alias("source_row_number"), payload.alias("payload"))
    empty = F.array().cast(ENTRIES)
    text = F.ltrim(payload_json)
    return (
        F.when(payload_json.isNull() | text.rlike(r"^\[\s*\]"), empty)
        .when(text.rlike(r"^\[\s*\{"), F.transform(tagged, lambda e: entry(F.coalesce(e["source_row_number"], row), F.coalesce(e["payload"], F.array().cast("array<string>")))))
        .when(text.rlike(r"^\[\s*\["), F.transform(lists, lambda p, i: entry(F.coalesce(F.get(numbers, i), row), p)))
        .otherwise(F.array(entry(row, texts)))
    )
