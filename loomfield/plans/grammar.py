"""The query language: words, "phrases", -exclusions and key:value filters, compiled to column predicates."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of kinds, and the corpora of each.
KINDS = {
    "file": "file", "files": "file", "doc": "doc", "docs": "doc", "document": "doc", "documents": "doc", "code": "code",
    "session": "session", "sessions": "session", "chat": "session", "agent": "session", "folder": "folder", "folders": "folder",
    "dir": "folder", "dirs": "folder", "directory": "folder", "repo": "repo", "repos": "repo", "repository": "repo",
    "person": "person", "people": "person", "who": "person", "author": "person",
}
CORPORA = {"file": ("file", "code"), "doc": ("file",), "code": ("code",), "session": ("session",), "folder": (), "repo": (), "person": ()}
#: Lengths of the units of a time back, and the days that have a name.
UNITS = {"h": dt.timedelta(hours=1), "d": dt.timedelta(days=1), "w": dt.timedelta(weeks=1), "m": dt.timedelta(days=30), "y": dt.timedelta(days=365)}
NAMED_DAYS = {"today": dt.timedelta(0), "yesterday": dt.timedelta(days=1)}


def _day(text: str, now: dt.datetime) -> dt.datetime | None:
    """Midnight of a named or written day."""
    if text in NAMED_DAYS:
        return dt.datetime.combine(now - NAMED_DAYS[text], dt.time.min)
    # Other ISO forms, such as weeks, aren't part of the language.
    return dt.datetime.strptime(text, "%Y-%m-%d") if len(text) == 10 else None


def when(value: str, now: dt.datetime, end: bool = False) -> dt.datetime:
    """A date (its end with `end`), a time back such as 12h or 3d, today or yesterday; ValueError for anything else."""
    text = value.strip().lower()
    count, unit = text[:-1], UNITS.get(text[-1:])
    if unit and count.isdecimal():
        return now - int(count) * unit
    day = _day(text, now)
    if day is None:
        raise ValueError(f"{value!r} is no date, time back, today or yesterday")
    return day + dt.timedelta(days=1) if end else day


@dataclass
class Query:
    words: list[str] = field(default_factory=list)
    exact: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    filters: dict = field(default_factory=dict)

    @property
    def semantic(self) -> str:
        return " ".join(self.words)


#: The tokens of the language, the first that fits; a quote that is never closed ends with the text.
_TOKENS = re.compile(
    r"""  -"(?P<unwanted>[^"]*)"?
        | "(?P<phrase>[^"]*)"?
        | (?P<key>[A-Za-z]+):(?P<value>\S+)
        | -(?P<without>[A-Za-z_]\w\w\S*)
        | (?P<word>\S+)
    """,
    re.VERBOSE,
)


def _name(value: str) -> str:
    return value.lower().lstrip(".")


#: What a filter's value becomes, by its key.
FILTERS = {
    "kind": lambda value, now: KINDS.get(_name(value), _name(value)),
    "ext": lambda value, now: _name(value),
    "in": lambda value, now: _name(value),
    "by": lambda value, now: _name(value),
    "project": lambda value, now: _name(value),
    "since": lambda value, now: when(value, now),
    "until": lambda value, now: when(value, now, end=True),
}


def parse(text: str, now: dt.datetime | None = None) -> Query:
    """Tokens from left to right. A minus excludes a phrase or a word of three or more characters; -p and --flag are words.

    `person:Sam` asks for the word among people; an unknown key makes a word.
    """
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    query = Query()
    lists = {"phrase": query.exact, "unwanted": query.exclude, "without": query.exclude, "word": query.words}
    for token in _TOKENS.finditer(text):
        sort, found = token.lastgroup, token[token.lastgroup]
        if sort in lists:
            lists[sort].extend([found.strip()] if found.strip() else [])
            continue
        key = token["key"].lower()
        if key in FILTERS:
            query.filters[key] = FILTERS[key](found, now)
        elif key == "person":
            query.filters["kind"] = key
            query.words.append(found)
        else:
            query.words.append(token[0])
    return query


@dataclass
class Fields:
    """The columns of a corpus that filters look at; a filter on a column it lacks drops every row."""

    text: str = "text"
    title: str | None = None
    path: str | None = None
    project: str | None = None
    author: str | None = None
    authors: str | None = None
    time: str | None = None
    kind: str | None = None


def predicate(query: Query, fields: Fields) -> Column:
    """The rows that a query's phrases, exclusions and filters let through, for Catalyst to push down."""
    col = lambda name: F.lower(F.coalesce(F.col(name), F.lit("")))
    text = col(fields.text)
    about = [col(c) for c in (fields.title, fields.path) if c]
    out = F.lit(True)
    for phrase in query.exact:
        found = text.contains(phrase.lower())
        for c in about[:1]:
            found = found | c.contains(phrase.lower())
        out = out & found
    for word in query.exclude:
        for c in (text, *about):
            out = out & ~c.contains(word.lower())
    known = {"ext": fields.path, "in": fields.path, "project": fields.project, "by": fields.author or fields.authors, "since": fields.time, "until": fields.time}
    for key, value in query.filters.items():
        if key == "kind":
            corpora = CORPORA.get(value, (value,))
            out = out & (F.col(fields.kind).isin(*corpora) if fields.kind and corpora else F.lit(bool(corpora)))
            continue
        name = known[key]
        if name is None:
            out = out & F.lit(False)
        elif key == "ext":
            out = out & col(name).endswith("." + value)
        elif key == "by" and fields.author is None:
            out = out & F.exists(F.map_keys(name), lambda k: F.lower(k).contains(value))
        elif key in ("since", "until"):
            bound = F.lit(value).cast("timestamp_ntz").cast("timestamp")
            out = out & ((F.col(name) >= bound) if key == "since" else (F.col(name) < bound))
        else:
            out = out & col(name).contains(value)
    return out
