"""Queries of row generators, parsers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators import chunk
from loomfield.plans.fixtures import CORPUS_SQL, corpus
from loomfield.plans.registry import query
from loomfield.session import table
from loomfield.sources import transcripts

_EXCHANGE = """ex AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1
    + max(CASE WHEN turn = first AND role <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS exchange
    FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations))"""


@query("g04_exchanges", f"WITH {_EXCHANGE} SELECT conv_id, turn, exchange::INT AS exchange FROM ex")
def exchanges(spark, sf):
    return chunk.exchanges(table(spark, sf, "conversations")).select("conv_id", "turn", "exchange")


@query("g04_exchange_sizes", f"WITH {_EXCHANGE} SELECT conv_id, exchange::INT AS exchange, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM ex GROUP BY ALL")
def exchange_sizes(spark, sf):
    rows = chunk.exchanges(table(spark, sf, "conversations"))
    return rows.groupBy("conv_id", "exchange").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("g01_session_chunks")
def session_chunks(spark, sf):
    return chunk.session_chunks(table(spark, sf, "conversations"))


@query("g02_code_chunks")
def code_chunks(spark, sf):
    return chunk.explode_chunks(table(spark, sf, "documents"), "doc_id", chunk.line_chunks(F.col("text")))


@query("g02_chunks_cover_lines", "SELECT doc_id, sum((trim(l, ' ' || chr(9) || chr(13)) <> '')::INT)::BIGINT AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def chunks_cover(spark, sf):
    rows = chunk.explode_chunks(table(spark, sf, "documents"), "doc_id", chunk.line_chunks(F.col("text")))
    lines = F.filter(F.split("body", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    return rows.groupBy("doc_id").agg(F.sum(F.size(lines)).alias("lines"))


@query("g03_text_chunks")
def text_chunks(spark, sf):
    """Each document, and it again on one line, which is cut by length."""
    d = table(spark, sf, "documents")
    whole = d.unionByName(d.withColumns({"doc_id": -F.col("doc_id") - 1, "text": F.translate("text", "\n", " ")}))
    return chunk.explode_chunks(whole, "doc_id", chunk.text_chunks(F.col("text")))


@query("g05_segments")
def segments(spark, sf):
    return chunk.segments(table(spark, sf, "conversations"))


@query("g11_ancestors", f"""WITH {CORPUS_SQL}, p AS (SELECT string_split(path, '/') AS s FROM corpus)
    SELECT folder, count(*) AS files FROM (SELECT unnest(list_transform(range(1, len(s)), lambda n: array_to_string(s[1:n], '/'))) AS folder FROM p) GROUP BY folder""")
def folders(spark, sf):
    rows = corpus(spark, sf).select(F.explode(tx.ancestors(F.col("path"))).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("files"))


@query("g12_area_of", f"WITH {CORPUS_SQL} SELECT doc_id, array_to_string(string_split(path, '/')[1:2], '/') AS area FROM corpus")
def areas(spark, sf):
    return corpus(spark, sf).select("doc_id", tx.area_of(F.col("path")).alias("area"))


@query("f_words", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n FROM documents")
def words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n"))


@query("f_code_words", """SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_extract_all(p_name || ' ' || p_type, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: lower(w)), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[0-9]')), ' ') AS words FROM part""")
def code_words(spark, sf):
    text = F.regexp_replace(F.concat_ws(" ", "p_name", "p_type"), "[0-9]+", " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.code_words(text), " ").alias("words"))


@query("f_code_tokens")
def code_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(tx.code_tokens(F.col("url")), " ").alias("tokens"))


@query("f_stems", "SELECT item_id, list_distinct(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: substr(w, 1, 6))).len() AS n FROM benchmark")
def stems(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(tx.stems(F.col("text"))).cast("long").alias("n"))


@query("f_repo_token", "SELECT DISTINCT source, 'zzrepo' || translate(substr(sha1(source), 1, 12), '0123456789abcdef', 'abcdefghijklmnop') AS token FROM documents")
def repo_tokens(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().select("source", tx.repo_token(F.col("source").cast("binary")).alias("token"))


@query("f_canonical_url", """SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1)) || '://' ||
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2)) || rtrim(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3), '/') AS url FROM pages""")
def canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query("f_hosts", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS pages FROM pages GROUP BY host")
def hosts(spark, sf):
    return table(spark, sf, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("pages"))


@query("s12_xml_text")
def xml_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.xml_text(F.col("html")).alias("text"))


@query("s12_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("p17_glob", f"WITH {CORPUS_SQL} SELECT doc_id FROM corpus WHERE regexp_matches(path, '^src/[^/]*/en/(.*/)?doc[^/]*[.]md$')")
def glob(spark, sf):
    return corpus(spark, sf).where(F.col("path").rlike(tx.glob_regex("src/*/en/**/doc*.md"))).select("doc_id")


@query("p19_written_source", """SELECT doc_id, octet_length(encode(text)) <= 120 * len(string_split(text, chr(10)))
    AND len(list_filter(string_split(text, chr(10)), lambda x: octet_length(encode(x)) > 500)) <= 0.01 * len(string_split(text, chr(10))) AS written FROM documents""")
def written(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.written_source(F.col("text")).alias("written"))


@query("p16_bots", "SELECT c_custkey, c_custkey % 6 IN (0, 1, 3, 5) AS bot FROM customer")
def bots(spark, sf):
    """Customers under six names in turn, of which four are bots'."""
    name = F.element_at(F.array(*map(F.lit, ("dependabot-x", "Codex", "Sam Abbot", "bot-7", "Claude Botha", "ci-bot"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", tx.is_bot(name).alias("bot"))


@query("p14_scope_contains", f"WITH {CORPUS_SQL} SELECT doc_id FROM corpus WHERE path = 'src/src1' OR starts_with(path, 'src/src1/') OR starts_with(path, 'src/src2/en/')")
def scope(spark, sf):
    path, folders = F.col("path"), ("src/src1", "src/src2/en")
    within = F.lit(False)
    for folder in folders:
        within = within | (path == folder) | path.startswith(folder + "/")
    return corpus(spark, sf).where(within).select("doc_id")


@query("p25_ticket_prefixes", "SELECT DISTINCT split_part(c_name, '#', 1) AS prefix FROM customer")
def prefixes(spark, sf):
    return table(spark, sf, "customer").select(F.substring_index("c_name", "#", 1).alias("prefix")).distinct()


@query("s24_windows", "SELECT doc_id, unnest(range(0, least(n_chars, 240 * 500), 500)) AS start FROM documents")
def media_windows(spark, sf):
    top = F.least(F.col("n_chars"), F.lit(240 * 500)).cast("long")
    return table(spark, sf, "documents").where("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), top - 1, F.lit(500).cast("long"))).alias("start"))


@query("a37_size_histogram", """SELECT CASE WHEN n_chars <= 100 THEN 0 WHEN n_chars <= 1000 THEN 1 WHEN n_chars <= 10000 THEN 2 ELSE 3 END AS bucket, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY bucket""")
def sizes(spark, sf):
    bucket = tx.size_class(F.col("n_chars"), (100, 1000, 10000))
    return table(spark, sf, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("x44_estimate_chunks", "SELECT source, sum(ceil(n_chars / 1000))::BIGINT AS chunks FROM documents WHERE n_chars > 0 GROUP BY source")
def estimate(spark, sf):
    return table(spark, sf, "documents").where("n_chars > 0").groupBy("source").agg(F.sum(F.ceil(F.col("n_chars") / 1000)).alias("chunks"))


@query("s05_titles_last_wins", """WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events)
    SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'purchase' AND r = 1), max(value) FILTER (WHERE event_type = 'click' AND r = 1), max(value) FILTER (WHERE event_type = 'view' AND r = 1)) AS title FROM e GROUP BY user_id""")
def last_title(spark, sf):
    rows = table(spark, sf, "events")
    return transcripts.last_by_kind(rows, "user_id", "event_id", "event_type", "value", ("purchase", "click", "view")).withColumnRenamed("chosen", "title")


@query("s22_last_line_per_id", "SELECT user_id, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events GROUP BY user_id")
def last_line(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("s04_json_props", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("g06_links")
def links(spark, sf):
    found = table(spark, sf, "conversations").select("conv_id", F.explode(tx.links(F.col("text"))).alias("l"))
    return found.groupBy("conv_id", "l.kind", "l.key").agg(F.count("*").alias("count"))
