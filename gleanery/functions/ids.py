"""Owners, upload names, costs and places as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARED = "shared"
OWNER_LENGTH = 64
#: USD for a million input, cached input and output tokens, and for a grounded request.
PRICES = {"input": 0.25, "cached": 0.025, "output": 1.50, "grounded": 0.014}


def filled(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def safe_owner(value: Column) -> Column:
    """An owner's name in a safe alphabet, cut, without dots, dashes and underscores at the ends; `shared` if nothing is left."""
    return filled(F.btrim(F.substring(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_"), 1, OWNER_LENGTH), F.lit("._-")), SHARED)


def owner_of(document_id: Column) -> Column:
    """upload:<owner>:<stem> belongs to the owner, anything else to all."""
    return filled(F.regexp_extract(document_id, r"^upload:([^:]*):(.+)$", 1), SHARED)


def upload_name(name: Column) -> Column:
    return filled(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._ -]+", "_"), F.lit(". ")), "upload")


def visible_to(owner: Column, document_id: Column) -> Column:
    of = owner_of(document_id)
    return (of == SHARED) | (of == owner)


def describe_location(file: Column, page: Column, section: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(file, F.lit(" p."), page.cast("string"))).when(F.nullif(section, F.lit("")).isNotNull(), F.concat(file, F.lit(" § "), section)).otherwise(file)


def estimate_cost(tokens_in: Column, tokens_out: Column, grounded: Column, cached: Column) -> Column:
    """USD, rounded to 6 digits; cached tokens are part of the input."""
    hit = F.greatest(F.lit(0), F.least(cached, tokens_in))
    usd = ((tokens_in - hit) * PRICES["input"] + hit * PRICES["cached"] + tokens_out * PRICES["output"]) / 1e6 + grounded * PRICES["grounded"]
    return F.round(usd, 6)
