"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import byte_bpe, decontaminate, divergence, language_id, line_dedup, packing, pii, quality_classifier, quality_rules, repeats, simhash, suffix_dedup, warc
from loomfield.llm.common import give_back, remainder
from loomfield.session import table

RANK_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_FILE = "byte_bpe_50k.json"


def quality_model(docs: DataFrame, labels: DataFrame):
    """The quality classifier, from labelled rows that are not held out."""
    known = labels.where(remainder("doc_id", 3) != 1)
    rows = quality_classifier.sample(
        docs, known, "doc_id", "text", "quality", quality_classifier.SAMPLE_PER_CLASS, quality_classifier.SAMPLE_BYTES
    )
    model = quality_classifier.train(rows)
    give_back()
    return model


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counted = [n(k).alias(f"n_{kind}") for k, kind in enumerate(pii.PATTERNS)]
    return out.select(
        "doc_id", *counted, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    keep = {"doc_id": F.col("doc_id"), "held_out": remainder("doc_id", 3) == 1}
    return quality_classifier.score(docs, model, keep=keep)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for its host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_lines(docs, "source", "text")
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, digests_only=True)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long")).alias(c)
    out = out.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))
    return out.withColumnRenamed("record_id", "page_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(remainder("doc_id", 5) != 0))
    return language_id.predict(docs, model, keep={"held_out": remainder("doc_id", 5) == 0})


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents with planted runs; see repeats.with_planted_runs."""
    out = repeats.find_runs(repeats.with_planted_runs(table(spark, sf_dir, "documents")))
    best = repeats.strongest(F.col("runs"))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_FILE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "window")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_packing": op13_packing,
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": """
        WITH line AS (
            SELECT doc_id, source, text, i, trim(l, ' ' || chr(9) || chr(13)) AS bare, l
            FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l,
                         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        ), total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
        often AS (
            SELECT source, bare FROM (SELECT DISTINCT doc_id, source, bare FROM line WHERE bare <> '')
            JOIN total USING (source) GROUP BY source, bare, pages
            HAVING count(*) >= 5 AND count(*) > 0.1 * pages
        ), marked AS (
            SELECT line.*, often.bare IS NOT NULL AS dropped
            FROM line LEFT JOIN often ON line.source = often.source AND line.bare = often.bare
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op8_warc": """
        WITH page AS (
            SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages
        ), grouped AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM page)
        SELECT page_id, octet_length(encode(body)) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                (('0x' || substr(sha, (k // 4) * 5 + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM grouped
    """,
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY lang, term HAVING count(*) >= 3),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p
            FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
        ), ln AS (SELECT lang, sum(total)::HUGEINT AS total FROM gn GROUP BY lang),
        lp AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 1) // (any_value(total) + any_value(v)) AS q
            FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), term AS (
            SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
            FROM p JOIN lp USING (lang, term) WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
            FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term)
        ) SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
