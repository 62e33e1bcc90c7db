"""Reading nested JSON answers with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from echoscore.functions.text import strip_fence
from echoscore.sources import schemas as S


def response_line(raw: Column) -> Column:
    """One response line as a struct; NULL fields wherever the line lacks a level."""
    return F.from_json(raw, S.RESPONSE_LINE)


def is_malformed(raw: Column) -> Column:
    """Not JSON at all, as opposed to JSON without an answer."""
    return F.try_parse_json(raw).isNull()


def file_uri(line: Column) -> Column:
    """URI of the first part of the first request content; NULL when missing or empty."""
    part = F.get(F.get(line["request"]["contents"], F.lit(0))["parts"], F.lit(0))
    uri = part["fileData"]["fileUri"]
    return F.when(uri != "", uri)


def answer_text(line: Column) -> Column:
    """Text of the first part of the first candidate, '' when any level is missing."""
    part = F.get(F.get(line["response"]["candidates"], F.lit(0))["content"]["parts"], F.lit(0))
    return F.coalesce(part["text"], F.lit(""))


def has_answer(line: Column) -> Column:
    """Whether the first candidate has at least one part."""
    parts = F.get(line["response"]["candidates"], F.lit(0))["content"]["parts"]
    return F.coalesce(F.size(parts) > 0, F.lit(False))


def chunk_number(key: Column) -> Column:
    """The number in 'req-<number>' or 'req-<number>-<rest>'; NULL for any other key."""
    return F.regexp_extract(key, r"\Areq-([^-]*)", 1).try_cast("bigint")


def boolean_list(answer: Column) -> Column:
    """Answer text (fenced or bare) as array<boolean>; only JSON true counts as true.

    Broken JSON, or JSON that is no array, gives an empty array.
    """
    items = F.from_json(strip_fence(answer), "array<variant>")
    flags = F.transform(
        items,
        lambda e: F.coalesce(
            (F.schema_of_variant(e) == "BOOLEAN") & F.try_variant_get(e, "$", "boolean"), F.lit(False)
        ),
    )
    return F.coalesce(flags, F.array().cast("array<boolean>"))


def critique_list(answer: Column) -> Column:
    """Answer text (fenced or bare) as an array of critique structs; NULL when it is no array."""
    text = strip_fence(answer)  # from_json would accept a lone object as an array of one
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, S.CRITIQUES))
