"""Queries of the language, retrieval and ranking."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.functions.numbers import cosine, dot
from loomfield.operators import evaluate, search
from loomfield.operators.vectors import block_products
from loomfield.plans.fixtures import CORPUS_SQL, corpus
from loomfield.plans.grammar import Fields, parse, predicate
from loomfield.plans.registry import query
from loomfield.session import table

FIELDS = Fields(text="text", title=None, path="path", project="source", author="author", time="at", kind="kind")
NOW = dt.datetime(2024, 6, 1)
TERMS = ["the", "thing", "ther", "erin"]
KEEP = ["doc_id", "path", "author", "kind"]
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _filtered(spark, sf, text: str) -> DataFrame:
    return corpus(spark, sf).where(predicate(parse(text, NOW), FIELDS)).select(*KEEP)


def _filter_query(name: str, text: str, condition: str) -> None:
    query(name, f"WITH {CORPUS_SQL} SELECT doc_id, path, author, kind FROM corpus WHERE {condition}")(lambda spark, sf: _filtered(spark, sf, text))


_filter_query("p03_phrase", '"the and"', "contains(lower(text), 'the and')")
_filter_query("p03_phrases", '"of the" "and"', "contains(lower(text), 'of the') AND contains(lower(text), 'and')")
_filter_query("p06_exclude", 'the -that -"of the"', "NOT contains(lower(text), 'that') AND NOT contains(lower(path), 'that') AND NOT contains(lower(text), 'of the') AND NOT contains(lower(path), 'of the')")
_filter_query("p07_ext", "ext:md", "lower(path) LIKE '%.md'")
_filter_query("p08_in", "in:src1/en", "contains(lower(path), 'src1/en')")
_filter_query("p09_by", "by:USER1", "contains(author, 'user1')")
_filter_query("p10_since_until", "since:2024-02-01 until:2024-03-01", "made >= TIMESTAMP '2024-02-01' AND made < TIMESTAMP '2024-03-02'")
_filter_query("p10_ago", "since:12w", "made >= TIMESTAMP '2024-06-01' - INTERVAL 84 DAY")
_filter_query("p11_project", "project:src2", "contains(lower(source), 'src2')")
_filter_query("p12_kind", "kind:code", "kind = 'code'")
_filter_query("p01_mixed", 'thing "and" -that kind:docs ext:txt in:src', "kind = 'file' AND lower(path) LIKE '%.txt' AND contains(lower(path), 'src') AND contains(lower(text), 'and') AND NOT contains(lower(text), 'that') AND NOT contains(lower(path), 'that')")


@query("q01_find", f"""WITH {CORPUS_SQL}, hit AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY made DESC, doc_id) AS r FROM corpus WHERE contains(lower(text), 'the') AND kind = 'file')
    SELECT doc_id, source, path FROM hit WHERE r = 1 ORDER BY made DESC, doc_id LIMIT 10""")
def find(spark, sf):
    order = [F.desc("at"), F.col("doc_id")]
    return search.find(corpus(spark, sf), parse('"the" kind:doc', NOW), FIELDS, "source", order, 10).select("doc_id", "source", "path")


@query("j02_snippet", f"""WITH {CORPUS_SQL}, flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM corpus WHERE contains(lower(text), 'thing')),
    placed AS (SELECT *, strpos(lower(f), 'thing') - 1 AS pos FROM flat WHERE strpos(lower(f), 'thing') > 0),
    started AS (SELECT *, greatest(pos - 60, 0) AS s0 FROM placed),
    spaced AS (SELECT *, CASE WHEN s0 > 0 AND strpos(substr(f, s0 + 1), ' ') > 0 THEN s0 + strpos(substr(f, s0 + 1), ' ') ELSE 0 END AS b FROM started),
    cut AS (SELECT *, CASE WHEN s0 > 0 AND b > 0 AND b - 1 < pos THEN b ELSE s0 END AS st FROM spaced)
    SELECT doc_id, (CASE WHEN st > 0 THEN '…' ELSE '' END) || substr(f, st + 1, 220) || (CASE WHEN st + 220 < length(f) THEN '…' ELSE '' END) AS snippet FROM cut""")
def snippets(spark, sf):
    rows = corpus(spark, sf).where(F.lower("text").contains("thing"))
    return rows.where(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).contains("thing")).select("doc_id", tx.snippet(F.col("text"), ["thing"]).alias("snippet"))


@query("x03_postings", f"""SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL""")
def postings(spark, sf):
    return search.postings(table(spark, sf, "documents"), "doc_id", F.col("text")).select("id", "term", "tf")


@query("x01_document_frequency", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term")
def frequency(spark, sf):
    return search.document_frequency(table(spark, sf, "documents"), F.col("text"))


@query("x01_rare_terms", f"""WITH df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term),
    own AS (SELECT * FROM df WHERE term IN ('the', 'thing', 'ther', 'erin')), n AS (SELECT count(*) AS n FROM documents),
    ranked AS (SELECT own.*, df <= 0.05 * n AS rare, row_number() OVER (ORDER BY df, term) AS r, max((df <= 0.05 * n)::INT) OVER () AS any_rare FROM own, n)
    SELECT term, df FROM ranked WHERE rare OR (any_rare = 0 AND r <= 2)""")
def rare(spark, sf):
    docs = table(spark, sf, "documents")
    return search.rare_terms(search.document_frequency(docs, F.col("text")), TERMS, docs.count())


_BM25 = f"""bm AS (WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL),
    dl AS (SELECT doc_id, len({_WORDS}) AS l FROM documents), st AS (SELECT count(*) AS n, avg(l) AS a FROM dl),
    own AS (SELECT * FROM p WHERE term IN ('thing', 'ther', 'erin')), d AS (SELECT term, count(*) AS df FROM own GROUP BY term)
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS s
    FROM own JOIN d USING (term) JOIN dl USING (doc_id), st GROUP BY doc_id)"""


def _bm25(spark, sf) -> DataFrame:
    return search.bm25(table(spark, sf, "documents"), ["thing", "ther", "erin"], "doc_id", F.col("text"))


@query("a35_bm25", f"WITH {_BM25} SELECT doc_id, round(s, 6) AS score FROM bm")
def bm25(spark, sf):
    return _bm25(spark, sf).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("score"))


@query("a35_bm25_top", f"WITH {_BM25} SELECT doc_id, round(s, 6) AS score FROM bm ORDER BY round(s, 6) DESC, doc_id LIMIT 20")
def bm25_top(spark, sf):
    scored = _bm25(spark, sf).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20)


_QV = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_SIM = "round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6)"


def _vector(spark, sf) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


@query("w09_vector_top_k", f"SELECT vec_id, {_SIM} AS sim FROM embeddings, {_QV} ORDER BY sim DESC, vec_id LIMIT 20")
def top_k(spark, sf):
    return search.nearest(table(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding", 20)


@query("n09_allow_list", f"SELECT vec_id, {_SIM} AS sim FROM embeddings, {_QV} WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') ORDER BY sim DESC, vec_id LIMIT 20")
def allowed(spark, sf):
    ids = table(spark, sf, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("vec_id"))
    return search.nearest(table(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding", 20, ids)


@query("p13_empty_scope", "SELECT vec_id, 0.0::DOUBLE AS sim FROM embeddings WHERE false")
def empty_scope(spark, sf):
    e = table(spark, sf, "embeddings")
    return search.nearest(e, _vector(spark, sf), "vec_id", "embedding", 20, e.where("false"))


@query("n13_dot_with_queries", f"""SELECT a.vec_id AS query, b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0""")
def dot_with_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return block_products(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", but_self=False)


@query("r12_similar", """WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_inner_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS sim
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s) SELECT query, id, sim, rank FROM r WHERE rank <= 8""")
def similar(spark, sf):
    e = table(spark, sf, "embeddings")
    return search.similar(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 8).withColumn("rank", F.col("rank").cast("long"))


@query("a34_centroids", """WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL)
    SELECT label, i::BIGINT AS pos, round(m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12), 6) AS value FROM p""")
def centroids(spark, sf):
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label"))) + 1e-12
    return means.select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round(F.col("m") / norm, 6).alias("value"))


@query("x05_cosine", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosines(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(b, e.vec_id + 1 == b.b).select(F.col("vec_id").alias("a"), "b", F.round(cosine(F.col("embedding"), F.col("y")), 5).alias("cosine"))


_DENSE = f"dense AS (SELECT vec_id AS doc_id, {_SIM} AS sim FROM embeddings, {_QV})"


def _signals(spark, sf) -> DataFrame:
    dense = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _vector(spark, sf)])), 6).alias("sim"))
    lexical = _bm25(spark, sf).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm"))
    return dense.join(lexical, "doc_id", "left")


@query("search_hybrid", f"""WITH {_BM25}, {_DENSE}, c AS (SELECT doc_id, sim, round(s, 6) AS bm FROM dense LEFT JOIN bm USING (doc_id)),
    f AS (SELECT doc_id, sim, coalesce(bm, min(bm) OVER ()) AS bm FROM c)
    SELECT doc_id, round((sim - avg(sim) OVER ()) / (stddev_pop(sim) OVER () + 1e-9) + 0.2 * (bm - avg(bm) OVER ()) / (stddev_pop(bm) OVER () + 1e-9), 4) AS blend FROM f""")
def hybrid(spark, sf):
    return search.blend(_signals(spark, sf), "sim", "bm").select("doc_id", F.round("blend", 4).alias("blend"))


@query("w03_z_score", "SELECT doc_id, lang, round((n_chars - avg(n_chars) OVER w) / (stddev_pop(n_chars) OVER w + 1e-9), 5) AS z FROM documents WINDOW w AS (PARTITION BY lang)")
def z_score(spark, sf):
    return search.z(table(spark, sf, "documents"), "n_chars", "lang").select("doc_id", "lang", F.round("z", 5).alias("z"))


@query("q21_rrf", f"""WITH {_BM25}, {_DENSE}, l AS (
        SELECT doc_id, 'd' AS source, row_number() OVER (ORDER BY sim DESC, doc_id) AS r FROM dense
        UNION ALL SELECT doc_id, 'k', row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) FROM bm)
    SELECT doc_id, round(sum(CASE source WHEN 'k' THEN 0.3 ELSE 1 END / (60 + r)), 8) AS rrf FROM l GROUP BY doc_id""")
def rrf(spark, sf):
    rows = search.similarities(table(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    lexical = _bm25(spark, sf).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm"))
    place = lambda r, c, s: search.global_rank(r.select("doc_id", c), "rank", F.desc(c), F.col("doc_id")).select("doc_id", F.lit(s).alias("source"), "rank")
    ranked = place(rows, "sim", "d").unionByName(place(lexical, "bm", "k"))
    return search.reciprocal_rank_fusion(ranked, ["doc_id"], {"k": 0.3}).select("doc_id", F.round("rrf", 8).alias("rrf"))


@query("w01_best_per_key", "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def best(spark, sf):
    return search.best_per_key(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")])


@query("w02_best_preferring_main", """SELECT label AS file, arg_max(vec_id, (CASE WHEN vec_id % 2 = 0 THEN 10 ELSE 0 END) + sim * 1.0 - vec_id * 1e-9) AS vec_id
    FROM (SELECT *, {sim} AS sim FROM embeddings, {qv}) GROUP BY label""".format(sim=_SIM, qv=_QV))
def best_main(spark, sf):
    rows = search.similarities(table(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding", "label")
    return rows.groupBy(F.col("label").alias("file")).agg(F.max_by("vec_id", F.struct(F.col("vec_id") % 2 == 0, "sim", -F.col("vec_id"))).alias("vec_id"))


@query("w04_tier_scores", """WITH t AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, n_chars, doc_id) AS r FROM documents),
    s AS (SELECT n_chars AS tier_score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT doc_id, tier_score FROM t JOIN s USING (r)""")
def tiers(spark, sf):
    return search.tiered_scores(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), [F.when(F.col("lang") == "en", 0).otherwise(1), F.col("n_chars")], "n_chars", "doc_id").select("doc_id", "tier_score")


@query("u01_candidate_union", f"""WITH {_BM25}, {_DENSE}, u AS (SELECT doc_id, sim, NULL::DOUBLE AS bm, false AS phrase FROM (SELECT * FROM dense ORDER BY sim DESC, doc_id LIMIT 50)
    UNION ALL SELECT doc_id, NULL, round(s, 6), false FROM bm UNION ALL SELECT doc_id, NULL, NULL, true FROM documents WHERE contains(text, 'of the'))
    SELECT doc_id, max(sim) AS sim, max(bm) AS bm, bool_or(phrase) AS phrase FROM u GROUP BY doc_id""")
def union(spark, sf):
    dense = search.nearest(table(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding", 50).select(F.col("vec_id").alias("doc_id"), "sim")
    lexical = _bm25(spark, sf).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm"))
    phrase = table(spark, sf, "documents").where(F.contains("text", F.lit("of the"))).select("doc_id", F.lit(True).alias("phrase"))
    rows = dense.unionByName(lexical, True).unionByName(phrase, True)
    return rows.groupBy("doc_id").agg(F.max("sim").alias("sim"), F.max("bm").alias("bm"), F.coalesce(F.bool_or("phrase"), F.lit(False)).alias("phrase"))


@query("x54_occurrences", """SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n, regexp_matches(text, '(^|[^A-Za-z])the([^A-Za-z]|$)') AS whole FROM documents""")
def occurrences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("the")).cast("long").alias("n"), F.col("text").rlike("(^|[^A-Za-z])the([^A-Za-z]|$)").alias("whole"))


@query("a41_hit_at_k", """WITH r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    g AS (SELECT item_id, min(rank) AS rank FROM r JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY item_id)
    SELECT count(*) AS n, round(avg((rank <= 1)::INT), 6) AS hit1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS hit3, round(avg(1.0 / rank), 6) AS mrr FROM g""")
def hits(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = table(spark, sf, "documents")
    found = docs.join(F.broadcast(items), F.contains(docs.text, items.passage)).select("item_id", "doc_id", "n_chars")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id")))
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return evaluate.hit_rates(ranked.join(good, "doc_id", "left_semi"), "item_id", "rank", (1, 3))


@query("x53_grep_ranks", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
    r AS (SELECT source, lang, n, (SELECT count(*) FROM c d WHERE d.source = c.source AND d.n > c.n) AS better, (SELECT count(*) FROM c d WHERE d.source = c.source AND d.n = c.n) AS ties FROM c)
    SELECT source, lang, round(least(1.0, greatest(0.0, (2 - better) / ties)), 6) AS p2 FROM r""")
def grep_ranks(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return evaluate.expected_hit(counts, "source", "n", 2).select("source", "lang", F.round("p", 6).alias("p2"))


@query("x47_hash_split", "SELECT item_id, ('0x' || right(sha1(text), 1))::INT % 2 AS dev FROM benchmark")
def hash_split(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", (F.conv(F.right(F.sha1("text"), F.lit(1)), 16, 10).cast("int") % 2).alias("dev"))


@query("x48_stratified_sample", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha1(doc_id::VARCHAR)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= n // 4")
def stratified(spark, sf):
    w = Window.partitionBy("lang")
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.row_number().over(w.orderBy(F.sha1(F.col("doc_id").cast("string").cast("binary")))).alias("r"), F.count("*").over(w).alias("n"))
    return rows.where("r <= n div 4").select("doc_id", "lang")
