"""Agent transcripts as tables: JSON lines to turns, titles, tool calls and token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions.text import clean_turn

_BLOCK = "array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,input:string,content:string>>"


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, line, value) of JSON-lines files below a folder. Line numbers count from 0 within a file."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(path)
    named = read.select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("all"))
    return named.select("file", F.posexplode("all").alias("line", "value")).where(F.trim("value") != "")


def discover(files: DataFrame, path: str = "file") -> DataFrame:
    """Transcripts proper: none of a subagents folder."""
    return files.where(~F.col(path).rlike("/subagents/"))


def claude_turns(raw: DataFrame) -> DataFrame:
    """(file, line, role, text) of message lines; meta and sidechain lines go, text blocks are joined by line ends."""
    schema = "type string, isMeta boolean, isSidechain boolean, cwd string, timestamp string, message struct<role:string,content:string>"
    rows = raw.withColumn("j", F.from_json("value", schema)).where("j.type IN ('user', 'assistant') AND NOT coalesce(j.isMeta, false) AND NOT coalesce(j.isSidechain, false)")
    content = F.get_json_object("value", "$.message.content")
    blocks = F.from_json(content, _BLOCK)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = clean_turn(F.when(F.ltrim(content).startswith("["), joined).otherwise(content))
    return rows.select("file", "line", F.col("j.type").alias("role"), text.alias("text")).where(F.col("text") != "")


def qwen_turns(raw: DataFrame) -> DataFrame:
    """As claude_turns, of messages made of parts; thoughts and notification lines go."""
    schema = "type string, subtype string, message struct<role:string,parts:array<struct<text:string,thought:boolean>>>"
    rows = raw.withColumn("j", F.from_json("value", schema)).where("j.type IN ('user', 'assistant') AND coalesce(j.subtype, '') NOT IN ('notification', 'cron')")
    parts = F.filter("j.message.parts", lambda p: p["text"].isNotNull() & ~F.coalesce(p["thought"], F.lit(False)))
    text = clean_turn(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"))
    return rows.select("file", "line", F.col("j.type").alias("role"), text.alias("text")).where(F.col("text") != "")


def codex_turns(raw: DataFrame) -> DataFrame:
    """As claude_turns, of payloads of type message."""
    schema = "type string, payload struct<type:string,role:string,content:array<struct<type:string,text:string>>>"
    rows = raw.withColumn("j", F.from_json("value", schema)).where("j.payload.type = 'message' AND j.payload.role IN ('user', 'assistant')")
    text = clean_turn(F.array_join(F.transform(F.col("j.payload.content"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n"))
    return rows.select("file", "line", F.col("j.payload.role").alias("role"), text.alias("text")).where(F.col("text") != "")


def memory_session(files: DataFrame, path: str = "file", text: str = "value") -> DataFrame:
    """(file, title, role, text) of markdown with front matter, one turn a file."""
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 1)
    body = F.when(front != "", F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 2)).otherwise(F.col(text))
    name = F.regexp_extract(front, r"(?m)^name:\s*(.+?)\s*$", 1)
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.select(F.col(path).alias("file"), F.when(name != "", name).otherwise(stem).alias("title"), F.lit("memory").alias("role"), F.btrim(body, F.lit(" \t\r\n")).alias("text"))


def tool_calls(raw: DataFrame) -> DataFrame:
    """(file, tool_use_id, name, input, result): each tool use with its result, by id within a file."""
    blocks = raw.select("file", "line", F.explode(F.from_json(F.get_json_object("value", "$.message.content"), _BLOCK)).alias("b"))
    used = blocks.where("b.type = 'tool_use'").select("file", "line", F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("name"), F.col("b.input").alias("input"))
    got = blocks.where("b.type = 'tool_result'").groupBy("file", F.col("b.tool_use_id").alias("tool_use_id")).agg(F.max_by("b.content", "line").alias("result"))
    return used.join(got, ["file", "tool_use_id"], "left")


def last_by_kind(rows: DataFrame, key: str, order: str, kind: str, value: str, precedence: tuple[str, ...]) -> DataFrame:
    """(key, chosen): the last value of the first kind by precedence that has one; an empty last value clears its kind."""
    last = [F.max_by(value, F.when(F.col(kind) == k, F.col(order))).alias(k) for k in precedence]
    got = rows.where(F.col(kind).isin(*precedence)).groupBy(key).agg(*last)
    blank = lambda k: F.when(F.col(k).cast("string") != "", F.col(k))
    return rows.select(key).distinct().join(got, key, "left").select(key, F.coalesce(*[blank(k) for k in precedence]).alias("chosen"))


def session_titles(raw: DataFrame) -> DataFrame:
    """(file, chosen): agentName before customTitle before aiTitle, the last of each."""
    kinds = ("agentName", "customTitle", "aiTitle")
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.get_json_object("value", f"$.{k}").alias("title")) for k in kinds])
    rows = raw.select("file", "line", F.explode(found).alias("t")).where("t.title IS NOT NULL").select("file", "line", "t.kind", "t.title")
    return last_by_kind(rows, "file", "line", "kind", "title", kinds)


def _count(path: str) -> Column:
    """A whole number in JSON; anything else, or nothing, is 0."""
    return F.coalesce(F.regexp_extract(F.get_json_object("value", path), r"^\d+$", 0).try_cast("long"), F.lit(0))


def claude_usage(raw: DataFrame) -> DataFrame:
    """(file, id, at, model, input, output, cache_write, cache_read, cache_write_1h): the last line of each message id."""
    rows = raw.where(F.get_json_object("value", "$.type") == "assistant").select(
        "file", "line", F.get_json_object("value", "$.message.id").alias("id"), F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("at"),
        F.get_json_object("value", "$.message.model").alias("model"), _count("$.message.usage.input_tokens").alias("input"), _count("$.message.usage.output_tokens").alias("output"),
        _count("$.message.usage.cache_creation_input_tokens").alias("cache_write"), _count("$.message.usage.cache_read_input_tokens").alias("cache_read"),
        _count("$.message.usage.cache_creation.ephemeral_1h_input_tokens").alias("cache_write_1h"),
    )
    newest = F.row_number().over(Window.partitionBy("file", "id").orderBy(F.desc("line")))
    return rows.where("id IS NOT NULL").withColumn("r", newest).where("r = 1").drop("r", "line")


def codex_usage(raw: DataFrame) -> DataFrame:
    """(file, line, at, input, output, cache_read): a line that repeats the last total is skipped; cached input is taken off."""
    base = "$.payload.info"
    rows = raw.where(F.get_json_object("value", "$.payload.type") == "token_count").select(
        "file", "line", F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("at"), _count(f"{base}.total_token_usage.total_tokens").alias("total"),
        _count(f"{base}.last_token_usage.input_tokens").alias("all_input"), _count(f"{base}.last_token_usage.output_tokens").alias("output"),
        _count(f"{base}.last_token_usage.cached_input_tokens").alias("cache_read"),
    )
    before = F.lag("total").over(Window.partitionBy("file").orderBy("line"))
    rows = rows.withColumn("before", before).where("before IS NULL OR before <> total")
    return rows.select("file", "line", "at", F.greatest(F.col("all_input") - F.col("cache_read"), F.lit(0)).alias("input"), "output", "cache_read")


def qwen_usage(raw: DataFrame) -> DataFrame:
    """(file, id, at, model, input, output, cache_read): thoughts count as output."""
    rows = raw.where(F.get_json_object("value", "$.usageMetadata").isNotNull()).select(
        "file", "line", F.get_json_object("value", "$.uuid").alias("id"), F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("at"),
        F.get_json_object("value", "$.model").alias("model"), _count("$.usageMetadata.promptTokenCount").alias("p"), _count("$.usageMetadata.cachedContentTokenCount").alias("cache_read"),
        (_count("$.usageMetadata.candidatesTokenCount") + _count("$.usageMetadata.thoughtsTokenCount")).alias("output"),
    )
    newest = F.row_number().over(Window.partitionBy("file", "id").orderBy(F.desc("line")))
    rows = rows.withColumn("r", newest).where("r = 1")
    return rows.select("file", "id", "at", "model", F.greatest(F.col("p") - F.col("cache_read"), F.lit(0)).alias("input"), "output", "cache_read")


def usage_by_hour(usage: DataFrame, at: str = "at") -> DataFrame:
    """(hour, model, calls and token sums)."""
    sums = [F.sum(c).alias(c) for c in ("input", "output", "cache_write", "cache_read") if c in usage.columns]
    return usage.groupBy(F.date_trunc("hour", at).alias("hour"), "model").agg(F.count("*").alias("calls"), *sums)
