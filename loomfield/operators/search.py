"""Retrieval: phrase search, BM25 over postings, exact dense top-k, blends and one best row a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.numbers import dot
from loomfield.functions.text import snippet, words
from loomfield.operators.vectors import block_products
from loomfield.plans.grammar import Fields, Query, predicate

K1, B = 1.2, 0.75
#: A query term in more than this share of the rows is dropped, unless all are.
RARE_SHARE = 0.05


def find(corpus: DataFrame, query: Query, fields: Fields, key: str, order: list[Column], limit: int, kept: list[str] | None = None) -> DataFrame:
    """Rows that satisfy a query, in the given order, with a snippet. Filters run before the limit, so none is lost."""
    rows = corpus.where(predicate(query, fields))
    best = best_per_key(rows, key, order)
    return best.orderBy(*order).limit(limit).select(*(kept or corpus.columns), snippet(F.col(fields.text), query.exact + query.words).alias("snippet"))


def best_per_key(rows: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key in the given order, which must be total for a result that repeats."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def postings(corpus: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, length): one aggregation on (id, term), combined before the shuffle."""
    terms = corpus.select(F.col(id_col).alias("id"), words(text).alias("terms")).select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def document_frequency(corpus: DataFrame, text: Column) -> DataFrame:
    terms = corpus.select(F.explode(F.array_distinct(words(text))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def bm25(corpus: DataFrame, terms: list[str], id_col: str, text: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(id, bm25) of the rows with a term of the query.

    The terms are a literal list, so the map side counts only them: one small row a matching document is
    shuffled nowhere, and the corpus totals come from one aggregation.
    """
    terms = sorted(set(terms))
    split = words(text)

    def times(term: str) -> Column:
        return F.size(F.filter("_terms", lambda w: w == term))

    counts = F.array(*map(times, terms))
    rows = corpus.select(F.col(id_col).alias("id"), split.alias("_terms")).select("id", F.size("_terms").alias("length"), counts.alias("tf"))
    totals = rows.agg(
        F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col("tf")[k] > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))]
    )
    hit = rows.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(totals))  # one row of totals
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean"))
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        score = score + idf * F.col("tf")[k] * (k1 + 1) / (F.col("tf")[k] + norm)
    return hit.select("id", score.alias("bm25"))


def rare_terms(frequency: DataFrame, terms: list[str], rows: int, share: float = RARE_SHARE, keep: int = 2) -> DataFrame:
    """(term, df) of the query's terms in at most `share` of the rows; if none are, the `keep` rarest."""
    own = frequency.where(F.col("term").isin(*terms))
    rare = own.withColumn("rare", F.col("df") <= share * rows).withColumn("any", F.max("rare").over(Window.partitionBy(F.lit(1))))
    rare = rare.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("df", "term")))  # the query's terms alone
    return rare.where(F.col("rare") | (~F.col("any") & (F.col("place") <= keep))).select("term", "df")


def similarities(vectors: DataFrame, query: list[float], id_col: str, vec_col: str, *keep: str) -> DataFrame:
    """(id, keep ..., sim) of every vector with one query vector; a projection, nothing is shuffled or sorted."""
    return vectors.select(id_col, *keep, F.round(dot(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])), 6).alias("sim"))


def nearest(vectors: DataFrame, query: list[float], id_col: str, vec_col: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(id, sim) of the k vectors nearest to one query vector, exact, with ties by id.

    `allowed` restricts to its ids; None means no restriction and an empty table none at all.
    """
    rows = vectors if allowed is None else vectors.join(allowed.select(id_col), id_col, "left_semi")
    return similarities(rows, query, id_col, vec_col).orderBy(F.desc("sim"), id_col).limit(k)


def similar(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query, id, sim, rank): the k nearest of each query vector, itself excluded. The queries may grow with the vectors (see `block_products`)."""
    sims = block_products(vectors, queries, id_col, vec_col, k)
    ranked = sims.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id")))
    return ranked.where(F.col("rank") <= k)


def z(rows: DataFrame, column: str, group: str) -> DataFrame:
    """`rows` with `z`, the population z-score of a column within groups; null where the value is.

    Moments are aggregated by group before they are shuffled, and joined back: a hot group's rows stay where they are.
    """
    moments = rows.groupBy(F.col(group).alias("_group")).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_spread"))
    joined = rows.join(moments, F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*rows.columns, ((F.col(column) - F.col("_mean")) / (F.col("_spread") + 1e-9)).alias("z"))


def standardise(rows: DataFrame, *columns: str) -> DataFrame:
    """Population z-scores of columns as z_<column>; a missing value counts as the least seen.

    The moments come from one aggregation, combined before its shuffle, whose single row goes to all tasks;
    no window gathers the rows in one place.
    """
    sums = []
    for c in columns:
        v = F.col(c).cast("double")
        sums += [F.min(v).alias(f"_min_{c}"), F.avg(v).alias(f"_avg_{c}"), F.var_pop(v).alias(f"_var_{c}"), F.count(v).alias(f"_n_{c}")]
    moments = rows.agg(F.count("*").alias("_n"), *sums)
    out = rows.crossJoin(F.broadcast(moments))
    for c in columns:
        held, least, mean, n = F.col(f"_n_{c}"), F.col(f"_min_{c}"), F.col(f"_avg_{c}"), F.col("_n")
        all_mean = (held * mean + (n - held) * least) / n
        spread = (held * (F.col(f"_var_{c}") + F.pow(mean - all_mean, F.lit(2))) + (n - held) * F.pow(least - all_mean, F.lit(2))) / n
        filled = F.coalesce(F.col(c).cast("double"), least)
        out = out.withColumn(c, filled).withColumn(f"z_{c}", (filled - all_mean) / (F.sqrt(spread) + 1e-9))
    return out.drop("_n", *[f"_{k}_{c}" for k in ("min", "avg", "var", "n") for c in columns])


def blend(candidates: DataFrame, dense: str, lexical: str, weight: float = 0.2) -> DataFrame:
    """`blend` = z(dense) + weight x z(lexical) over a candidate set; a signal that is missing counts as the least seen."""
    out = standardise(candidates, dense, lexical)
    return out.withColumn("blend", F.col(f"z_{dense}") + weight * F.col(f"z_{lexical}")).drop(f"z_{dense}", f"z_{lexical}")


def global_rank(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """`rows` with `name`, the place of each in a total order, from 1.

    Rows are dealt out by ranges of the order and numbered within a range; a row for each range, with what
    the ranges before it hold, goes to all tasks. The dealt rows are checkpointed, so the ranges stay.
    """
    from loomfield.operators.linkage import _cut

    dealt = _cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}))
    first = dealt.groupBy("_range").agg(F.count("*").alias("_size"), F.min("_nth").alias("_first"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    placed = dealt.join(F.broadcast(first.select("_range", "_first", before.alias("_before"))), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_nth") - F.col("_first") + 1).drop("_range", "_nth", "_first", "_before")


def reciprocal_rank_fusion(ranked: DataFrame, key: list[str], weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """(key, rrf): sum of weight / (k + rank) over the `source` lists that rank a key."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    return ranked.groupBy(*key).agg(F.sum(weight / (k + F.col("rank"))).alias("rrf"))


def tiered_scores(rows: DataFrame, tier: list[Column], score: str, key: str) -> DataFrame:
    """Hands the sorted scores out in the order of the tiers: the first row by tier gets the largest score."""
    by_tier = global_rank(rows, "_place", *tier, F.col(key))
    by_score = global_rank(rows.select(F.col(score).alias("tier_score"), key), "_place", F.desc("tier_score"), F.col(key)).select("tier_score", "_place")
    return by_tier.join(by_score, "_place").drop("_place")


def code_rank(rows: DataFrame, key: str, dense: str = "sim", lexical: str = "bm", text: str = "text", path: str = "path", phrase: str = "", name: str = "") -> DataFrame:
    """(key, rank_score) of candidate chunks: z(dense) + 0.2 z(lexical), less 0.5 in tests, more for the phrase and its count,
    for its case, for the name by how few chunks have it, and for its definition if three at most define it."""
    from loomfield.functions.text import is_test_path

    out = blend(rows, dense, lexical).withColumn("rank_score", F.col("blend") - F.when(is_test_path(F.col(path)), 0.5).otherwise(0.0))
    if phrase:
        times = (F.length(F.lower(text)) - F.length(F.replace(F.lower(text), F.lit(phrase.lower()), F.lit("")))) / len(phrase)
        cased = F.contains(text, F.lit(phrase)).cast("int")
        out = out.withColumn("rank_score", F.col("rank_score") + F.when(times > 0, 3 + F.log1p(times) + cased).otherwise(0.0))
    if name:
        has = F.contains(text, F.lit(name))
        defined = F.col(text).rlike(rf"\b(?:def|class|func|fn|function|struct|interface|type)\s+{name}\b")
        out = out.crossJoin(F.broadcast(rows.agg(F.count_if(has).alias("_has"), F.count_if(defined).alias("_def"))))
        bonus = F.when(has, 2 / F.log2(1.0 + F.col("_has"))).otherwise(0.0) + F.when(defined & (F.col("_def") <= 3), 2.0).otherwise(0.0)
        out = out.withColumn("rank_score", F.col("rank_score") + bonus)
    return out.select(key, "rank_score")


def path_match(path: Column, wanted: list[str]) -> Column:
    """Share of the words that a path has; a word of four or more letters also matches by prefix. 0.15 more if its last part has one."""
    parts = F.transform(F.split(F.lower(path), "/"), words)

    def hit(among: Column, word: str) -> Column:
        return F.exists(among, lambda w: (w == word) | (w.startswith(word) if len(word) >= 4 else F.lit(False)))

    cover = F.lit(0.0)
    for word in wanted:
        cover = cover + hit(F.flatten(parts), word).cast("double") / len(wanted)
    last = F.lit(False)
    for word in wanted:
        last = last | hit(F.element_at(parts, -1), word)
    return cover + F.when(last, 0.15).otherwise(0.0)


def focus_line(text: Column, terms: list[str], phrase: str = "", name: str = "") -> Column:
    """(n, score, line) of the best line: stems in common, three for the phrase, four for the name; the first of equals."""
    from loomfield.functions.text import stems

    wanted = F.array(*[F.lit(t[:6].lower()) for t in terms]) if terms else F.array().cast("array<string>")

    def rated(line: Column, i: Column) -> Column:
        score = F.size(F.array_intersect(stems(line), wanted))
        if phrase:
            score = score + 3 * F.contains(F.lower(line), F.lit(phrase.lower())).cast("int")
        if name:
            score = score + 4 * F.contains(line, F.lit(name)).cast("int")
        return F.struct(score.alias("score"), (-i).alias("back"), line.alias("line"))

    best = F.array_max(F.transform(F.split(text, "\n", -1), rated))
    return F.struct((1 - best["back"]).cast("int").alias("n"), best["score"].alias("score"), best["line"].alias("line"))
