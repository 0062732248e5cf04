"""Files, version-control exports and chat text as tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
EXCLUDED = ("node_modules", "__pycache__", "venv", "dist", "build", "target", "Library", "Pods")
SECRET = r"(?i)(^|/)(\.env(\..*)?|id_rsa|id_ed25519|.*\.(pem|key|p12|pfx|keychain)|credentials(\.json)?|\.npmrc|\.netrc)$"
KINDS = {
    "document": "pdf doc docx odt rtf txt md pages".split(), "sheet": "xls xlsx csv numbers".split(), "slides": "ppt pptx key".split(),
    "code": "py js ts tsx jsx go rs java c h cc cpp swift rb php sql sh scala kt".split(), "image": "png jpg jpeg gif webp heic".split(),
    "sound": "mp3 wav m4a flac".split(), "mail": ["eml"], "web": "html htm".split(),
}


def walk(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, size, mtime[, content]) of the files below a folder; hidden, excluded and secret ones go."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hidden = F.col("path").rlike(r"/\.[^/]+")
    kept = read.where(~hidden & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED])) & ~F.col("path").rlike(SECRET))
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("other")
    for kind, known in KINDS.items():
        out = F.when(ext.isin(*known), kind).otherwise(out)
    return out


_TAGS = re.compile(r"<[^>]+>")
_BREAKS = re.compile(r"</(?:w:p|a:p|text:p|p|div|li|tr|h[1-6])>|<(?:br|w:br|text:line-break)[ /]*>", re.I)


def _plain(markup: str) -> str:
    from html import unescape

    return unescape(_TAGS.sub("", _BREAKS.sub("\n", markup))).strip()


def extract_text(path: str, data: bytes) -> str:
    """Text of one file by its extension; empty where it can't be read or is binary."""
    ext = path.rpartition(".")[2].lower()
    parts = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/sharedStrings\.xml", "odt": r"content\.xml"}
    try:
        if ext in parts:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                names = sorted((n for n in archive.namelist() if re.fullmatch(parts[ext], n)), key=lambda n: (len(n), n))
                joiner = " " if ext == "xlsx" else "\n"
                return "\n".join(_plain(archive.read(n).decode("utf-8", "replace").replace("</t>", "</t>" + joiner)) for n in names)
        if ext == "eml":
            mail = message_from_bytes(data, policy=policy.default)
            body = mail.get_body(("plain", "html"))
            text = body.get_content() if body else ""
            return f"{mail.get('subject', '')}\n{_plain(text) if body and body.get_content_subtype() == 'html' else text}".strip()
        if b"\0" in data[:4000]:
            return ""
        text = data.decode("utf-8", "replace")
        if ext == "rtf":
            return re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", re.sub(r"\\par[d]?\b", "\n", text)).strip()
        return _plain(text) if ext in ("html", "htm", "xml") else text
    except (zipfile.BadZipFile, KeyError, LookupError, ValueError):
        return ""


def extract(files: DataFrame) -> DataFrame:
    """(path, text) of `files` (path, content), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract_text(p, bytes(c or b"")) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def author_of(metadata: Column, indexed: Column, owner: Column) -> Column:
    """(author, source) by precedence: the file's metadata, the system's index, the file's owner."""
    named = lambda c, s: F.when(F.trim(c) != "", F.struct(F.trim(c).alias("author"), F.lit(s).alias("source")))
    return F.coalesce(named(metadata, "metadata"), named(indexed, "index"), named(owner, "owner"))


def git_log(lines: DataFrame, order: str = "line", text: str = "value") -> DataFrame:
    """(repo, sha, at, author, subject, path, added, deleted) of `git log --numstat --format=@%H%x09%ct%x09%an <%ae>%x09%s`.

    Input is (repo, line, value). The commit of a file's line is the last header above it.
    """
    head = F.col(text).startswith("@")
    w = Window.partitionBy("repo").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("h", F.last(F.when(head, F.split(F.substring(text, 2, 1 << 20), "\t", 4)), True).over(w)).withColumn("f", F.split(text, "\t", 3))
    files = rows.where(~head & F.col(text).rlike(r"^(\d+|-)\t(\d+|-)\t"))
    number = lambda k: F.coalesce(F.col("f")[k].try_cast("long"), F.lit(0))
    return files.select(
        "repo", F.col("h")[0].alias("sha"), F.timestamp_seconds(F.col("h")[1].cast("long")).alias("at"), F.col("h")[2].alias("author"), F.col("h")[3].alias("subject"),
        F.col("f")[2].alias("path"), number(0).alias("added"), number(1).alias("deleted"),
    )


def git_blame(lines: DataFrame, me: str, order: str = "line", text: str = "value") -> DataFrame:
    """(repo, path, n, author, at) of `git blame --line-porcelain`; uncommitted lines are credited to `me`."""
    w = Window.partitionBy("repo", "path").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda p: F.last(F.when(F.col(text).rlike(p), F.regexp_extract(text, p, 1)), True).over(w)
    rows = lines.withColumns({"n": carried(r"^[0-9a-f]{40} \d+ (\d+)"), "who": carried(r"^author (.*)$"), "t": carried(r"^author-time (\d+)$")})
    author = F.when(F.col("who") == "Not Committed Yet", me).otherwise(F.col("who"))
    return rows.where(F.col(text).startswith("\t")).select("repo", "path", F.col("n").cast("int").alias("n"), author.alias("author"), F.timestamp_seconds(F.col("t").cast("long")).alias("at"))


def codeowners(lines: DataFrame, text: str = "value") -> DataFrame:
    """(owner, n): mentions in CODEOWNERS lines; comments go."""
    parts = F.split(F.trim(F.regexp_replace(text, r"#.*$", "")), r"\s+")
    owners = lines.where(F.size(parts) > 1).select(F.explode(F.slice(parts, 2, 1000)).alias("owner"))
    return owners.groupBy("owner").agg(F.count("*").alias("n"))


def chat_messages(raw: DataFrame, text: str = "value") -> DataFrame:
    """(user, name, body) of exported chat text with `=== Message from NAME (ID) ===` heads."""
    head = r"=== Message from (.*?) \((\w+)\)[^=]*===\s*"
    heads = F.regexp_extract_all(text, F.lit(head), F.lit(0))
    bodies = F.slice(F.split(text, head, -1), 2, 1 << 20)
    rows = raw.select(F.explode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("m"))
    return rows.select(F.regexp_extract("m.h", head, 2).alias("user"), F.regexp_extract("m.h", head, 1).alias("name"), F.trim("m.b").alias("body"))
