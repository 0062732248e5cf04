"""Names typed as one word, and messages as they look at runtime, read with the words that the code has."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, islice, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions import text as tx

#: Readings of a name, and the least length of a fragment.
READINGS, FRAGMENT = 8, 8
#: Characters of fragments that a task holds before it sends them on; those of a message are as many as the square of its words.
SENT = 4_000_000
NAME = r"^[^A-Za-z]*((?:[a-z][a-z0-9]*)|(?:[A-Z][A-Z0-9]*))[^A-Za-z0-9]*$"


def _splits(word: str, known: set[str], prefix: bool) -> list[str]:
    """The first READINGS ways to cut `word` into two or more known parts, by place of the first cut, then the second, and so on.

    The last part may be the start of a word if `prefix`. First, from the end, it is found from which places the end can be
    reached; only these are entered, so the work is that of the readings found.
    """
    size = len(word)
    ends = {i for i in range(2, size - 1) if prefix or word[i:] in known}
    steps: dict[int, list[int]] = {}
    reached = set(ends)
    for i in range(size - 4, -1, -1):
        steps[i] = [j for j in range(i + 2, size - 1) if j in reached and word[i:j] in known]
        if steps[i]:
            reached.add(i)

    def cuts(i: int) -> Iterator[tuple[int, ...]]:
        """Places of the cuts after i, where a list comes before those that go on from it."""
        for j in steps.get(i, ()):
            if j in ends:
                yield (j,)
            yield from ((j, *more) for more in cuts(j))

    return [" ".join(word[a:b] for a, b in pairwise((0, *found, size))) for found in islice(cuts(0), READINGS)]


def joined_names(names: DataFrame, vocabulary: DataFrame, name: str = "name", prefix: bool = False) -> DataFrame:
    """(name, reading) of names of 4 to 32 letters and digits in one case: "textarea" is also "text area".

    Parts are words of `vocabulary` (word), two characters or more. The parts of a name (465 at most) are joined with the
    vocabulary, which may be large; only those found come together for one name. Other names, nulls and names without a reading
    give no row, repeats one.
    """
    word = F.lower(F.regexp_extract(name, NAME, 1))
    own = names.select(F.col(name).alias("name"), word.alias("word")).where(F.length("word").between(4, 32)).distinct()
    n = F.length("word")
    cuts = own.select("name", "word", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    parts = cuts.select("name", "word", "i", F.explode(F.sequence(F.lit(2), n - F.col("i") + 1)).alias("k")).select("name", "word", F.expr("substring(word, i, k)").alias("part"))
    known = parts.join(vocabulary.select(F.col("word").alias("part")).distinct(), "part", "left_semi").groupBy("name", "word").agg(F.collect_set("part").alias("known"))
    if prefix:
        known = own.join(known, ["name", "word"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))

    @F.pandas_udf("array<string>")
    def readings(words: pd.Series, sets: pd.Series) -> pd.Series:
        return pd.Series([_splits(w, set(s), prefix) for w, s in zip(words, sets, strict=True)])

    return known.select("name", F.explode(readings("word", "known")).alias("reading"))


def _code_words(text: str) -> list[str]:
    parts = [p for w in re.findall(r"[A-Za-z][A-Za-z0-9]*", text) for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", w)]
    return [p.lower() for p in parts if len(p) > 1]


def _fragments(message: str, often: dict[str, int]) -> tuple[list[str], bool]:
    """Fixed parts of a message, longest first, then parts with one word left out, rarest first; whether it had values in it."""

    def is_value(token: str) -> bool:
        words = _code_words(token)
        return token.isdecimal() or (bool(words) and all(often.get(w, 0) == 0 for w in words))

    runs = [(value, "".join(tokens).strip()) for value, tokens in groupby(re.findall(r"\d+|\s+|[^\s\d]+", message), key=is_value)]
    fixed = sorted((text for value, text in runs if not value and len(text) >= FRAGMENT), key=len, reverse=True)
    parts = []
    for text in fixed:
        words = text.split()
        for n, left_out in enumerate(words):
            rarity = min((often.get(w, 0) for w in _code_words(left_out)), default=0)
            parts += [(rarity, -len(side), side) for side in map(" ".join, (words[:n], words[n + 1 :])) if len(side) >= FRAGMENT]
    ordered = dict.fromkeys(fixed) | dict.fromkeys(side for *_, side in sorted(parts))
    ordered.pop(message, None)
    return list(ordered), any(value for value, _ in runs)


def fragments(messages: DataFrame, frequencies: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, fragments, holes) of messages: the text that a program may hold of them, to be searched as phrases.

    A message is cut at numbers and at words that no code has by `frequencies` (word, df); then each piece is also given without
    one of its words, the rarest first. Only the frequencies of a message's own words are brought to it. Null texts are empty.
    """
    own = messages.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = own.select("id", F.explode(F.array_distinct(tx.code_words(F.col("text")))).alias("word"))
    held = words.join(frequencies.select("word", "df"), "word").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", F.col("df").cast("long")))).alias("often"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for key, text, often in batch.itertuples(index=False):
                found, has_values = _fragments(text, dict(often) if often is not None else {})
                rows.append((key, found, has_values))
                size += sum(map(len, found))
                if size >= SENT:
                    yield pd.DataFrame(rows, columns=["id", "fragments", "holes"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["id", "fragments", "holes"])

    kind = own.schema["id"].dataType.simpleString()
    return own.join(held, "id", "left").select("id", "text", "often").mapInPandas(run, f"id {kind}, fragments array<string>, holes boolean")
