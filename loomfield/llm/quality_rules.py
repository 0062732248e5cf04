"""Quality rules: counts of every text, and robust multivariate outliers among the texts that pass them.

Transformed counts form a vector for each text. For each language and source a minimum-covariance-
determinant estimate gives a centre and scatter that outlying texts do not move, and a text is rejected
if its Mahalanobis distance exceeds a chi-square quantile. All in DataFrame operations: the counts stay
in the row; each concentration step is one grouped aggregation over a narrow table of vectors; the
scatter's triangular factor is written out as column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import SPACE, materialize

WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"
#: The fixed rules.
MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Share of a group's rows that the estimate rests on, concentration steps, and rows a group needs of its own.
SUPPORT = 0.75
STEPS = 4
MIN_ROWS = 60
#: The 1 - 1e-6 quantile of chi-square with four degrees of freedom, on distances scaled so that the median row has the median of chi-square.
CUTOFF = 33.38
MEDIAN = 3.357
#: Least standard deviations: a statistic that hardly varies in a group rejects no text for a small change.
FLOORS = {"x_word": 0.15, "x_symbol": 0.35, "x_line": 0.5, "x_repeat": 0.8}
NAMES = tuple(FLOORS)
RANK_ACCURACY = 10_000
#: A group's rows are dealt out over so many keys when its estimate is joined back.
SALTS = 32


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of each whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    out = docs.select("*", text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    out = out.withColumn("_hashes", F.when(n > WINDOW, hashes))
    # Named twice, the hashes stay a column of their own; named once, they would be inlined and made anew for each window.
    windows = F.transform(F.sequence(F.lit(1), F.size("_hashes") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))
    out = out.withColumn("_windows", F.when(n > WINDOW, windows))
    # Only a text with a repeated window sorts them. Equal neighbours give the places of all windows found twice or more.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    before = lambda i: F.element_at("_sorted", F.greatest(i, F.lit(1)))["h"]
    after = lambda i: F.element_at("_sorted", F.least(i + 2, F.size("_sorted")))["h"]
    found = F.filter("_sorted", lambda x, i: ((i > 0) & (before(i) == x["h"])) | ((i + 1 < F.size("_sorted")) & (after(i) == x["h"])))
    out = out.withColumn("_places", F.array_sort(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(s["end"], p)).cast("long").alias("n"), (p + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    return out.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _vector(n_words: str = "n_words") -> list[Column]:
    n = F.greatest(F.col(n_words), F.lit(1))
    share = lambda c: F.log1p(100.0 * F.col(c) / n)
    return [
        F.log1p(F.col("word_chars") / n).alias("x_word"),
        share("n_symbols").alias("x_symbol"),
        share("n_dup_lines").alias("x_line"),
        share("n_repeat_words").alias("x_repeat"),
    ]


def _distance(centre: str = "m_", factor: str = "l_") -> Column:
    """Squared Mahalanobis distance: forward substitution with the triangular factor in the row."""
    solved: list[Column] = []
    for i, a in enumerate(NAMES):
        rest = F.col(a) - F.col(centre + a)
        for j in range(i):
            rest = rest - F.col(f"{factor}{i}{j}") * solved[j]
        solved.append(rest / F.col(f"{factor}{i}{i}"))
    total = F.lit(0.0)
    for z in solved:
        total = total + z * z
    return total


def _moments(rows: DataFrame) -> DataFrame:
    """Centre and triangular factor (l_ij) of each group's scatter, each floor's square added to its variance."""
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
    out = rows.groupBy("group").agg(
        *[F.avg(c).alias("m_" + c) for c in NAMES], *[F.covar_pop(NAMES[i], NAMES[j]).alias(f"s_{i}{j}") for i, j in pairs]
    )
    for i, j in pairs:
        value = F.col(f"s_{i}{j}") + (F.lit(FLOORS[NAMES[i]] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            value = value - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
        # The floors keep the diagonal positive; rounding may take a hair of it.
        value = F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l_{j}{j}")
        out = out.withColumn(f"l_{i}{j}", value)
    return out.drop(*[f"s_{i}{j}" for i, j in pairs])


def _beside(vectors: DataFrame, of_group: DataFrame) -> DataFrame:
    """`vectors` (with a `salt`) joined with a table of one row a group, a large group's rows in many tasks."""
    return vectors.join(of_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["group", "salt"])


def estimates(vectors: DataFrame) -> DataFrame:
    """Centre, factor and scale of each `group` of `vectors` (group, salt and the statistics).

    Starts from the medians and mean absolute deviations, then concentrates: each step takes the SUPPORT
    share of rows nearest to the last estimate, which never raises the determinant.
    """
    middle = vectors.groupBy("group").agg(*[F.percentile_approx(c, 0.5, RANK_ACCURACY).alias("m_" + c) for c in NAMES])
    spread = _beside(vectors, middle).groupBy("group").agg(
        *[F.first("m_" + c).alias("m_" + c) for c in NAMES], *[F.avg(F.abs(F.col(c) - F.col("m_" + c))).alias("d_" + c) for c in NAMES]
    )
    for i, a in enumerate(NAMES):
        for j in range(i + 1):
            spread = spread.withColumn(f"l_{i}{j}", F.col("d_" + a) + FLOORS[a] if i == j else F.lit(0.0))
    now = materialize(spread.drop(*["d_" + c for c in NAMES]))
    for _ in range(STEPS):
        measured = _beside(vectors, now).select("group", "salt", *NAMES, _distance().alias("d"))
        cut = measured.groupBy("group").agg(F.percentile_approx("d", SUPPORT, RANK_ACCURACY).alias("cut"))
        now = materialize(_moments(_beside(measured, cut).where("d <= cut")))
    measured = _beside(vectors, now).select("group", _distance().alias("d"))
    scale = measured.groupBy("group").agg(F.percentile_approx("d", 0.5, RANK_ACCURACY).alias("middle"))
    return now.join(scale, "group").withColumn("scale", F.greatest(F.col("middle") / MEDIAN, F.lit(1.0)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Each row's id, the counts, `base_failed`, `distance` (null where base_failed) and `kept`.

    Groups are by language and source; one with fewer than MIN_ROWS rows joins the rest of its language, and
    then of all rows. A null language or source is a value of its own. Null and empty texts have no words
    and fail the base rules. Repeated rows count and stay.
    """
    known = counts(docs.select(F.col(id_col), *[F.col(c).cast("string").alias(c) for c in by], F.col(text_col)), text_col).drop(text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    levels = [F.to_json(F.struct(*[F.col(c) for c in by[: len(by) - k]], F.lit(k).alias("level"))) for k in range(len(by))]
    known = materialize(known.withColumn("base_failed", failed).select("*", *_vector(), *[g.alias(f"g{k}") for k, g in enumerate(levels)]))
    passed = known.where("not base_failed")
    group, named = F.lit("all"), known
    for k in reversed(range(len(by))):
        large = materialize(passed.groupBy(f"g{k}").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS).select(F.col(f"g{k}").alias(f"own{k}")))
        named = named.join(large, F.col(f"g{k}") == F.col(f"own{k}"), "left")
    group = F.coalesce(*[F.col(f"own{k}") for k in range(len(by))], F.lit("all"))
    salt = F.pmod(F.xxhash64(F.col(id_col).cast("string"), "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    named = named.withColumn("group", group).withColumn("salt", salt)
    of = estimates(named.where("not base_failed").select("group", "salt", *NAMES))
    of = materialize(of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    out = named.join(of, ["group", "salt"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept")
    )
