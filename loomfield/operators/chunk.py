"""Row generators: chunkers, exchanges and topic segments."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "array<struct<first:int,last:int,body:string>>"
#: Words without a theme.
STOP = frozenset(
    "about above after again against also always and any are because been before being below between both but can could did does "
    "doing done down during each few for from further get got had has have having her here hers him his how into its itself just let "
    "like make more most much must myself need new not now off once only other our ours out over own same she should some such than "
    "that the their theirs them then there these they this those through too under until very was were what when where which while "
    "who whom why will with would yes you your yours lets let's dont don't it's i'm i'll ok okay thanks sure look see use using used one".split()
)
SHIFT, MIN_EXCHANGES, MIN_WORDS = 0.12, 2, 4


def line_chunks(text: Column, size: int = 1500, soft: int = 700) -> Column:
    """Chunks (first, last, body) of whole lines: a chunk ends at `size` characters, or at a blank line past `soft`.

    A fold over the lines in the row. Its state holds the open chunk and those that are closed; blank chunks go.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    blank = lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) == ""

    def add(s: Column, x: Column) -> Column:
        n = s["size"] + F.char_length(x["line"]) + 1
        body = F.when(s["size"] == 0, x["line"]).otherwise(F.concat(s["open"], F.lit("\n"), x["line"]))
        first = F.when(s["size"] == 0, x["n"]).otherwise(s["first"])
        close = (n >= size) | ((n > soft) & blank(x["line"]))
        chunk = F.struct(first.cast("int").alias("first"), x["n"].cast("int").alias("last"), body.alias("body"))
        return F.struct(
            F.when(close, F.concat(s["done"], F.array(chunk))).otherwise(s["done"]).cast(_CHUNK).alias("done"),
            F.when(close, "").otherwise(body).alias("open"), first.cast("int").alias("first"), x["n"].cast("int").alias("last"), F.when(close, 0).otherwise(n).cast("int").alias("size"),
        )

    start = F.struct(F.array().cast(_CHUNK).alias("done"), F.lit("").alias("open"), F.lit(1).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("size"))
    rest = lambda s: F.when(s["size"] > 0, F.concat(s["done"], F.array(F.struct(s["first"], s["last"], s["open"].alias("body"))).cast(_CHUNK))).otherwise(s["done"])
    return F.filter(F.aggregate(lines, start, add, rest), lambda c: ~blank(c["body"]))


def text_chunks(text: Column, size: int = 1500, cap: int = 0) -> Column:
    """`line_chunks` that end at a blank line past two fifths of `size`; one over twice `size`, a very long line, is cut every `size`.

    Pieces of a long line keep its line numbers, and what is left of it is up to twice `size` long. `cap` keeps the first chunks
    (0: all), as the surveyed engine does for previews.
    """
    over = lambda c: F.greatest(F.ceil((F.char_length(c["body"]) - 2 * size) / size), F.lit(0)).cast("int")
    piece = lambda c, j: F.struct(c["first"].alias("first"), c["last"].alias("last"), F.when(j < over(c), F.substring(c["body"], j * size + 1, F.lit(size))).otherwise(F.substring(c["body"], j * size + 1, F.char_length(c["body"]))).alias("body"))
    pieces = F.flatten(F.transform(line_chunks(text, size, size * 2 // 5), lambda c: F.transform(F.sequence(F.lit(0), over(c)), lambda j: piece(c, j))))
    kept = F.filter(pieces, lambda c: c["body"].rlike(r"\S"))
    return F.slice(kept, 1, cap) if cap else kept


def explode_chunks(docs: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    return docs.select(id_col, F.posexplode(chunks).alias("idx", "chunk")).select(id_col, "idx", "chunk.first", "chunk.last", "chunk.body")


def exchanges(turns: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """`turns` with `exchange`, counted from 0: each starts at a user turn, and what precedes the first is one."""
    over = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum((F.col(role) == "user").cast("int")).over(over)
    leading = F.max(F.when(F.row_number().over(Window.partitionBy(session).orderBy(turn)) == 1, (F.col(role) != "user").cast("int"))).over(over)
    return turns.withColumn("exchange", (opened - 1 + leading).cast("int"))


def session_chunks(turns: DataFrame, size: int = 1800, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(session, idx, body): exchanges packed into chunks by paragraphs; a paragraph beyond `size` is cut hard."""
    prefix = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "memory", "Memory: ").otherwise("Assistant: ")
    whole = exchanges(turns).groupBy(session, "exchange").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, F.concat(prefix, "text").alias("line")))), lambda x: x["line"]), "\n\n").alias("text")
    )
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(p) - 1, F.lit(0)).cast("int"), F.lit(size)), lambda a: F.substring(p, a + 1, F.lit(size)))
    parts = F.flatten(F.transform(F.split("text", "\n\n", -1), cut))

    def add(s: Column, p: Column) -> Column:
        close = (s["open"] != "") & ((F.char_length(s["open"]) + F.char_length(p) > size) | (F.char_length(p) == size))
        opened = F.when(close | (s["open"] == ""), p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        return F.struct(F.when(close, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), opened.alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    packed = F.aggregate(parts, start, add, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    rows = whole.select(session, "exchange", F.posexplode(packed).alias("nth", "body"))
    idx = F.row_number().over(Window.partitionBy(session).orderBy("exchange", "nth")) - 1
    return rows.select(session, idx.cast("int").alias("idx"), "body")


def bag(text: str) -> Counter:
    """Content words, lower case."""
    return Counter(w for w in (x.lower() for x in re.findall(r"[A-Za-z][A-Za-z0-9_]{2,}", text)) if w not in STOP)


def bag_cosine(a: Counter, b: Counter) -> float:
    size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b[k] for k, v in a.items()) / size if size else 0.0


def segments(turns: DataFrame, session: str = "conv_id", turn: str = "turn", shift: float = SHIFT, least: int = MIN_EXCHANGES) -> DataFrame:
    """(session, component, first_turn, end_turn, exchanges): stretches of a session about one theme.

    Each exchange is compared with the words so far, so it runs in order within a session, in one Arrow group.
    """
    kind = turns.select(session).schema[0].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grouped: list[tuple[list[int], Counter]] = []
        for place, who, text in sorted(zip(frame[turn], frame["role"], frame["text"], strict=True)):
            if who == "user" or not grouped:
                grouped.append(([], Counter()))
            grouped[-1][0].append(int(place))
            grouped[-1][1].update(bag(text or ""))
        out: list[list] = []
        centre: Counter = Counter()
        for places, own in grouped:
            new = sum(own.values()) >= MIN_WORDS and out and out[-1][3] >= least and bag_cosine(own, centre) < shift
            if new or not out:
                out.append([len(out), places[0], places[-1] + 1, 0])
                centre = Counter()
            out[-1][2], out[-1][3] = places[-1] + 1, out[-1][3] + 1
            centre.update(own)
        table = pd.DataFrame(out, columns=["component", "first_turn", "end_turn", "exchanges"])
        table.insert(0, session, frame[session].iloc[0])
        return table

    rows = turns.select(session, turn, "role", "text")
    return rows.groupBy(session).applyInPandas(run, f"{session} {kind}, component int, first_turn int, end_turn int, exchanges int")


