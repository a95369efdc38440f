"""Text column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT_MAP = "map<string,string>"


def flat_map(attributes) -> Column:
    """Attribute JSON as an ordered text map; NULL when the JSON cannot be read."""
    return F.from_json(attributes, FLAT_MAP)


def clip(text, n: int = 28) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def entity_text(name="name", category="category", attributes="attributes") -> Column:
    """``name（category） k:v；k:v`` with attributes in stored order; a null value prints as ``null``."""
    pairs = F.transform(
        F.map_entries(flat_map(F.col(attributes))),
        lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("null"))),
    )
    attrs = F.coalesce(F.array_join(pairs, "；"), F.lit(""))
    head = F.concat(F.col(name), F.lit("（"), F.col(category), F.lit("）"))
    return F.when(attrs != "", F.concat(head, F.lit(" "), attrs)).otherwise(head)


def changed_keys(before: Column, after: Column) -> Column:
    """Keys of map ``after`` whose text differs from ``before``, without ``id``."""
    text = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(""))
    return F.filter(F.map_keys(after), lambda k: (k != "id") & (text(before, k) != text(after, k)))


def diff_text(before: Column, after: Column) -> Column:
    """``key→new value`` for every changed field, joined by ``，``; empty when a side is missing."""
    shown = F.transform(
        changed_keys(before, after), lambda k: F.concat(k, F.lit("→"), clip(F.element_at(after, k)))
    )
    return F.coalesce(F.array_join(shown, "，"), F.lit(""))


def safe_file_name(name) -> Column:
    """Last path part with unusual characters replaced, at most 80 characters."""
    base = F.element_at(F.split(F.coalesce(name, F.lit("document")), r"[\\/]"), -1)
    base = F.substring(F.regexp_replace(base, "[^A-Za-z0-9_.\\-一-龥]", "_"), 1, 80)
    return F.when(base == "", "document").otherwise(base)


def iso_time(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Fixed value: characters that count as white space at the ends of a text.
SPACES = " \t\n\r\x0b\x0c                 　﻿"


def strip(text) -> Column:
    return F.btrim(text, F.lit(SPACES))
