"""Items of services as one document shape: (kind, key, title, url, status, updated_at, text, people)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where each service keeps a field, first that is there.
FIELDS = {
    "github": {"key": ["html_url", "url"], "title": ["title"], "url": ["html_url", "url"], "status": ["state"], "updated_at": ["updated_at", "updatedAt"], "text": ["body"], "person": ["user.login", "author.login"]},
    "linear": {"key": ["identifier", "id"], "title": ["title"], "url": ["url"], "status": ["state.name", "status"], "updated_at": ["updatedAt"], "text": ["description"], "person": ["assignee.name", "assignee"]},
    "asana": {"key": ["gid"], "title": ["name"], "url": ["permalink_url"], "status": ["completed"], "updated_at": ["modified_at"], "text": ["notes"], "person": ["assignee.name"]},
    "notion": {"key": ["id"], "title": ["title", "properties.title"], "url": ["url"], "status": ["status"], "updated_at": ["last_edited_time"], "text": ["text"], "person": ["created_by.name"]},
    "hubspot": {"key": ["id"], "title": ["properties.dealname", "properties.name"], "url": ["url"], "status": ["properties.dealstage"], "updated_at": ["updatedAt"], "text": ["properties.description"], "person": ["properties.hubspot_owner_id"]},
    "drive": {"key": ["id"], "title": ["name", "title"], "url": ["webViewLink", "url"], "status": [], "updated_at": ["modifiedTime"], "text": ["content"], "person": ["owners[0].displayName"]},
    "granola": {"key": ["id"], "title": ["title"], "url": ["url"], "status": [], "updated_at": ["updated_at", "created_at"], "text": ["notes", "summary"], "person": ["owner.name"]},
    "slack": {"key": ["permalink", "ts"], "title": ["channel.name", "channel"], "url": ["permalink"], "status": [], "updated_at": ["ts"], "text": ["text"], "person": ["username", "user"]},
}


def split(results: DataFrame, raw: str = "raw", depth: int = 4) -> DataFrame:
    """(row, item): the longest list of objects that bear an id, at most `depth` levels down each result's JSON."""

    def lists(value, level: int) -> Iterator[list]:
        if isinstance(value, list):
            if value and all(isinstance(x, dict) and ({"id", "key", "gid", "url", "identifier", "ts"} & x.keys()) for x in value):
                yield value
        if level and isinstance(value, dict | list):
            for inner in value.values() if isinstance(value, dict) else value:
                yield from lists(inner, level - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text in zip(batch["row"], batch[raw], strict=True):
                try:
                    found = max(lists(json.loads(text or "null"), depth), key=len, default=[])
                except ValueError:
                    found = []
                out += [(row, json.dumps(x, sort_keys=True)) for x in found]
            yield pd.DataFrame(out, columns=["row", "item"])

    return results.select("row", raw).mapInPandas(run, "row long, item string")


def normalise(items: DataFrame, service: str, item: str = "item") -> DataFrame:
    """One document a JSON item of a service; fields that none of the aliases has are null."""
    fields = FIELDS[service]
    first = lambda names: F.coalesce(*[F.get_json_object(item, f"$.{n}") for n in names]) if names else F.lit(None).cast("string")
    rows = items.select(F.lit(service).alias("service"), *[first(names).alias(name) for name, names in fields.items()], F.sha1(F.col(item).cast("binary")).alias("hash"))
    return rows.where("key IS NOT NULL").withColumn("kind", item_kind(F.lit(service), F.col("url"), F.col("key")))


def item_kind(service: Column, url: Column, key: Column) -> Column:
    """The kind of a document by its url, key and service."""
    return (
        F.when(url.rlike(r"/pull/\d+"), "pr").when(url.rlike(r"/issues/\d+") | key.rlike(r"^[A-Z][A-Z0-9]{1,9}-\d+$"), "ticket")
        .when(service.isin("asana", "linear"), "ticket").when(service == "slack", "message").when(service == "granola", "meeting").when(service == "hubspot", "deal").otherwise("document")
    )


def status_state(status: Column) -> Column:
    """done, close, progress or todo from a service's status text."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.rlike(r"\b(done|closed|resolved|complete|completed|shipped|released|merged|true)\b"), "done").when(s.rlike(r"review|qa|testing|merging"), "close").when(s.rlike(r"progress|doing|started|active|open"), "progress").otherwise("todo")
