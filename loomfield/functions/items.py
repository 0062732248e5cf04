"""Collected items as JSON of many services: title, address, key, time and readable text of their fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that services give to a title, an address, a key, and to what an object is called.
TITLES = ("summary", "title", "name", "subject", "text")
URLS = ("html_url", "webUrl", "url", "permalink", "permalink_url", "link")
KEYS = ("key", "identifier", "gid", "number", "ts", "id", "url", "permalink", "webUrl")
CALLED = ("displayName", "name", "value", "title", "real_name", "email", "key")
#: Fields that say nothing to a reader, and those that change with every look.
NOISE = re.compile(r"avatar|icon|^self$|_links|thumbnail|^expand$|schema|^context$|featureflags|^etag$", re.I)
VOLATILE = {"updated", "updated_at", "updatedAt", "modified", "lastModified", "last_modified", "edited_at"}
#: Entries of a list and depth of objects that are shown.
ENTRIES, DEPTH = 30, 2


def parsed(item: Column) -> Column:
    """The item as a variant; null for what is no JSON."""
    return F.try_parse_json(item)


def _at(item: Column, name: str) -> Column:
    """A field's value, from `fields` first, where some services keep them."""
    inner = F.try_variant_get(item, f"$.fields.{name}", "variant")
    return F.coalesce(inner, F.try_variant_get(item, f"$.{name}", "variant"))


def _text(item: Column, name: str) -> Column:
    value = _at(item, name)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def title(item: Column, key: Column) -> Column:
    """The first line, up to 120 characters, of the first title that isn't blank; else the key."""
    lines = [F.substring(F.split(F.btrim(_text(item, n), F.lit(" \t\r\n")), "\n")[0], 1, 120) for n in TITLES]
    return F.coalesce(*[F.when(x != "", x) for x in lines], key)


def url(item: Column) -> Column:
    """The first address that a browser can open; empty for none."""
    found = [_text(item, n) for n in URLS]
    return F.coalesce(*[F.when(x.startswith("http") & ~x.contains("://api."), x) for x in found], F.lit(""))


def key(item: Column) -> Column:
    """The first text or whole number among the names of keys, as text; null for none."""
    whole = lambda v: F.schema_of_variant(v).isin("STRING", "BIGINT")
    values = [F.try_variant_get(item, f"$.{n}", "variant") for n in KEYS]
    return F.coalesce(*[F.nullif(F.when(whole(v), F.try_variant_get(v, "$", "string")), F.lit("")) for v in values])


def when(item: Column, *names: str) -> Column:
    """Seconds since 1970 of the first of some fields: a time as text, or seconds or milliseconds as number or text."""

    def seconds(name: str) -> Column:
        text = F.try_variant_get(_at(item, name), "$", "string")
        number = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))
        return F.coalesce(F.when(number > 1e11, number / 1000).otherwise(number).cast("long"), F.unix_timestamp(F.try_to_timestamp(text)))

    return F.coalesce(*[seconds(n) for n in names])


def short(value):
    """An object as the name that it is called by, if it has one."""
    if isinstance(value, dict):
        return next((value[k] for k in CALLED if isinstance(value.get(k), str)), value)
    return value


def shown(value, depth: int = 0) -> str:
    """A value as text: objects as indented lines `name: text` to a depth of two, lists in a line or as entries."""
    value, below = short(value), "\n" + "  " * (depth + 1)
    match value:
        case dict() if depth < DEPTH:
            told = {k: x for k, x in value.items() if x not in (None, "", [], {}) and not NOISE.search(k)}
            return "".join(f"{below}{k}: {shown(x, depth + 1)}" for k, x in told.items())
        case dict():
            return ""
        case list():
            texts = [text for x in value[:ENTRIES] if (text := shown(x, depth + 1))]
            nested = any(isinstance(short(x), dict | list) for x in value)
            return "".join(f"{below}- {text.strip()}" for text in texts) if nested else ", ".join(texts)
        case _:
            return str(value)


def _told(text: str | None) -> list[dict]:
    try:
        item = json.loads(text) if text else {}
    except ValueError:
        item = {}
    item = item if isinstance(item, dict) else {}
    inner = item.get("fields")
    flat = {k: v for k, v in item.items() if k != "fields"} | inner if isinstance(inner, dict) else item
    kept = {k: v for k, v in flat.items() if not NOISE.search(k) and k not in VOLATILE and v not in (None, "", [], {})}
    return [{"field": k, "text": shown(v).strip(), "simple": isinstance(short(v), str | int | float | bool)} for k, v in kept.items()]


def fields(item: Column) -> Column:
    """The fields of an item (JSON text) that a reader wants: name, text, and whether a change of it is worth a line of history."""

    @F.pandas_udf("array<struct<field:string,text:string,simple:boolean>>")
    def told(items: pd.Series) -> pd.Series:
        return pd.Series([_told(x) for x in items])

    return told(item)
