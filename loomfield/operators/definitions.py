"""The definition around a line of code, and what lies beside a file."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.operators.areas import folder

#: Lines of a definition that are shown whole, and of its head where it is longer.
MOST, HEAD = 200, 10
#: Endings of settings and documents, and entries that say nothing.
CONTEXT_ENDS = (".yml", ".yaml", ".json", ".toml", ".md", ".cfg", ".ini", ".sql", ".sh")
SKIPPED = ("__pycache__", "node_modules", ".git", ".DS_Store", "__init__.py")


def _defined(source: str) -> list[tuple[str, int, int, int]]:
    """(name, first line with decorators, last line, depth) of functions and classes; none where the source doesn't parse."""
    try:
        todo = [(node, 0) for node in ast.parse(source).body]
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []
    while todo:
        node, depth = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            found.append((node.name, min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno or node.lineno, depth))
            depth += 1
        todo += [(child, depth) for child in ast.iter_child_nodes(node)]
    return found


def definitions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, name, start, end, depth) of the Python files among (path, text); a file is parsed where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *d) for p, t in zip(batch["path"], batch["text"], strict=True) for d in _defined(t)]
            yield pd.DataFrame(rows, columns=["path", "name", "start", "end", "depth"])

    code = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where("path LIKE '%.py' AND text IS NOT NULL")
    return code.mapInPandas(run, "path string, name string, start long, end long, depth int")


def enclosing(hits: DataFrame, defined: DataFrame) -> DataFrame:
    """(path, line, name, start, end) of hits (path, line): the innermost definition that holds each; hits outside any give no row.

    Definitions of one depth don't overlap. So at each depth of a file only the last one that starts at or before the line can
    hold it, which one sort of definitions and hits by line finds; the deepest that does is the innermost. No pair of a hit and
    a definition is made.
    """
    depths = defined.select("path", "depth").distinct()
    own = hits.select("path", "line").distinct().join(depths, "path").select("path", "depth", "line", F.lit(1).alias("hit"), F.lit(None).cast("struct<name:string,start:bigint,end:bigint>").alias("d"))
    marks = defined.select("path", "depth", F.col("start").alias("line"), F.lit(0).alias("hit"), F.struct("name", "start", "end").alias("d"))
    before = Window.partitionBy("path", "depth").orderBy("line", "hit").rowsBetween(Window.unboundedPreceding, 0)
    last = marks.unionByName(own.select("path", "depth", F.col("line").cast("long").alias("line"), "hit", "d")).withColumn("last", F.last("d", ignorenulls=True).over(before))
    held = last.where((F.col("hit") == 1) & (F.col("last.end") >= F.col("line")))
    return held.groupBy("path", "line").agg(F.max_by("last", "depth").alias("d")).select("path", "line", "d.name", "d.start", "d.end")


def excerpts(found: DataFrame, files: DataFrame) -> DataFrame:
    """`found` of `enclosing` with text and truncated: a definition whole, or if over MOST lines its HEAD and the lines around the hit."""
    lines = F.split("text", "\n")
    size = F.col("end") - F.col("start") + 1
    from_ = F.greatest(F.col("start") + HEAD, F.col("line") - MOST // 2)
    gap = F.when(from_ > F.col("start") + HEAD, F.array(F.concat(F.lit("    … lines "), F.col("start") + HEAD, F.lit("-"), from_ - 1, F.lit(" …")))).otherwise(F.array().cast("array<string>"))
    rest = F.lit(MOST - HEAD) - F.size(gap)
    piece = lambda at, n: F.slice(lines, at.cast("int"), n.cast("int"))
    cut = F.concat(piece(F.col("start"), F.lit(HEAD)), gap, piece(from_, F.least(rest, F.col("end") - from_ + 1)))
    shown = F.when(size > MOST, cut).otherwise(piece(F.col("start"), size))
    return found.join(files.select("path", "text"), "path").select(*found.columns, F.array_join(shown, "\n").alias("text"), (size > MOST).alias("truncated"))


def siblings(paths: DataFrame, most: int = 8) -> DataFrame:
    """(path, beside) of paths: the other entries of the folder, test folders first, then settings and documents, other folders, the rest.

    Hidden and SKIPPED entries are left out; beyond `most` their number is told. Entries are ranked once a folder, and only the first
    `most` + 1 of a folder meet its files.
    """
    own = paths.select("path").distinct().withColumn("folder", folder(F.col("path")))
    files = own.select("folder", F.substring_index("path", "/", -1).alias("entry"), F.lit(False).alias("is_folder"))
    inside = own.where("folder <> '.'").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda n: F.slice(F.split("folder", "/"), 1, n))).alias("up")).distinct()
    above = F.array_join(F.slice("up", F.lit(1), F.size("up") - 1), "/")
    folders = inside.select(F.when(F.size("up") > 1, above).otherwise(F.lit(".")).alias("folder"), F.element_at("up", -1).alias("entry"), F.lit(True).alias("is_folder"))
    ends = F.regexp_extract("entry", r"(\.[^.]*)$", 1)
    rank = F.when(F.col("is_folder"), F.when(F.col("entry").contains("test"), 0).otherwise(2)).otherwise(F.when(ends.isin(*CONTEXT_ENDS), 1).otherwise(3))
    shown = ~F.col("entry").startswith(".") & ~F.col("entry").isin(*SKIPPED)
    entries = files.unionByName(folders).where(shown).withColumn("rank", rank)
    total = entries.groupBy("folder").agg(F.count("*").alias("n"))
    placed = entries.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("rank", "entry", "is_folder"))).where(F.col("r") <= most + 1)
    listed = placed.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "entry", "is_folder"))), lambda e: F.struct(e["entry"].alias("entry"), e["is_folder"].alias("is_folder"))).alias("listed")).join(total, "folder")
    me = F.substring_index("path", "/", -1)
    others = F.slice(F.filter("listed", lambda e: (e["entry"] != me) | e["is_folder"]), 1, most)
    listed_too = F.when(me.startswith(".") | me.isin(*SKIPPED), 0).otherwise(1)
    more = F.col("n") - listed_too - most
    names = F.transform(others, lambda e: F.concat(e["entry"], F.when(e["is_folder"], "/").otherwise("")))
    beside = F.when(more > 0, F.concat(names, F.array(F.concat(F.lit("+"), more, F.lit(" more"))))).otherwise(names)
    return own.join(listed, "folder", "left").select("path", F.coalesce(beside, F.array().cast("array<string>")).alias("beside"))
