"""Tasks: sessions, branches, tickets, commits and collected items that belong together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.operators.linkage import group
from loomfield.operators.rounds import written

#: Branches that are no task's own.
DEFAULT_BRANCHES = ("", "HEAD", "main", "master", "develop", "dev", "trunk")
#: Fixed patterns of ticket keys in texts and branch names, and of words of titles.
KEY = r"\b([A-Z][A-Z0-9]{1,9}-[0-9]{1,6})\b"
BRANCH_KEY = r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9]{1,9}[-_][0-9]{1,6})(?![0-9])"
TITLE_WORD = r"([a-z0-9][a-z0-9.+#-]*)"
#: Words of titles that say nothing.
STOP = (
    "a", "an", "the", "and", "or", "for", "of", "to", "in", "on", "with", "from", "into", "by", "at", "is", "it",
    "this", "that", "my", "our", "how", "what", "why", "do", "does", "can", "we", "i", "vs", "via", "new",
)
DAYS, LONG_SESSIONS, LONG_DAYS, SHARED_FILE_MAX, TEXT_KEYS, ITEM_KEYS = 3, 6, 4, 3, 3, 3
DAY = 86_400


@dataclass
class Tasks:
    """members (task, node) and cards (task, title, updated, sessions, tickets, branches, commits, items)."""

    members: DataFrame
    cards: DataFrame


def keys_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KEY), F.lit(1)))


def branch_keys(branch: Column) -> Column:
    """Keys in a branch's name, in any case, with - or _."""
    found = F.regexp_extract_all(branch, F.lit(BRANCH_KEY), F.lit(1))
    return F.array_distinct(F.transform(found, lambda k: F.upper(F.translate(k, "_", "-"))))


def _project(key: Column) -> Column:
    return F.regexp_extract(key, "^(.*)-", 1)


def _near(rows: DataFrame, *keys: str) -> DataFrame:
    """Pairs of rows (id, day, at, ...) with equal keys that are up to DAYS apart, the earlier as a: joined on stretches of DAYS."""
    early = rows.withColumn("_slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))
    a = early.select(*keys, "_slot", F.col("id").alias("a"), F.col("at").alias("at_a"), F.col("repo").alias("repo_a"))
    b = rows.select(*keys, F.col("slot").alias("_slot"), F.col("id").alias("b"), F.col("at").alias("at_b"), F.col("repo").alias("repo_b"))
    near = a.join(b, [*keys, "_slot"]).where("(at_a < at_b OR (at_a = at_b AND a < b)) AND at_b - at_a <= " + str(DAYS * DAY))
    return near.drop("_slot")


def same_files(sessions: DataFrame, edits: DataFrame) -> DataFrame:
    """(a, b) of sessions (id, repo, at) of one repository, DAYS apart at most, that edited (id, path) two specific files, or one that only they did.

    A file is specific if SHARED_FILE_MAX sessions at most edited it, so a file gives a few pairs only.
    """
    own = edits.select("id", "path").distinct().join(sessions, "id")
    n = own.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n").between(2, SHARED_FILE_MAX))
    rows = own.join(n, "path").where("repo IS NOT NULL").withColumn("slot", F.floor(F.col("at") / (DAYS * DAY)))
    pairs = _near(rows, "path", "n").where("repo_a = repo_b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("files"), F.min("n").alias("least")).where("files >= 2 OR least = 2").select("a", "b")


def same_topic(sessions: DataFrame, stop: tuple[str, ...] = STOP) -> DataFrame:
    """(a, b) of sessions (id, repo, title, at), DAYS apart at most and not of two repositories, whose titles share half of their words.

    Two titles that share half of all their words share one of the rarest n - ceil(n / 2) + 1 of each; only these are joined.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(TITLE_WORD), F.lit(1)))
    own = sessions.withColumn("words", F.filter(words, lambda w: ~w.isin(*stop)) if stop else words).where(F.size("words") >= 2)
    df = own.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = own.select("id", "repo", "at", F.size("words").alias("size"), F.explode("words").alias("word")).join(df, "word")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "word")))
    rare = ranked.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") / 2) + 1).withColumn("slot", F.floor(F.col("at") / (DAYS * DAY)))
    pairs = _near(rare, "word").where("repo_a IS NULL OR repo_b IS NULL OR repo_a = repo_b").select("a", "b").distinct()
    bag = lambda c: own.select(F.col("id").alias(c), F.col("words").alias(f"{c}_words"))
    both = pairs.join(bag("a"), "a").join(bag("b"), "b")
    return both.where(F.size(F.array_intersect("a_words", "b_words")) * 2 >= F.size(F.array_union("a_words", "b_words"))).select("a", "b")


def topic_links(sessions: DataFrame, stop: tuple[str, ...] = STOP) -> DataFrame:
    """(a, b) that tie the same sessions together as the pairs of `same_topic` do, but few: as components need them.

    Sessions of one repository with the same words are a stretch while none is over DAYS after the one before; such are tied in a
    star. Stretches with other words, or of no repository, are tied once for any two of their sessions that `same_topic` pairs.
    In a slot of DAYS any two stretches are near; with the next slot, the last of the one is compared with the first of the other.
    What two stretches can still share from a word on, the rarest first, must be half of all; so a common word joins few of them.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(TITLE_WORD), F.lit(1)))
    own = sessions.withColumn("words", F.array_sort(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words)).where((F.size("words") >= 2) & F.col("at").isNotNull())
    in_order = Window.partitionBy("repo", "words").orderBy("at", "id")
    begins = F.coalesce(F.col("at") - F.lag("at").over(in_order) > DAYS * DAY, F.lit(True))
    own = own.withColumn("head", F.when(begins, F.col("id")))
    own = written(own.withColumn("head", F.last("head", True).over(in_order)).select("id", "repo", "words", "at", "head"))
    star = own.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))

    stretch = own.select("head", "repo", "words").distinct()
    each = stretch.select("head", "repo", F.size("words").alias("size"), F.explode("words").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    rare_first = Window.partitionBy("head", "repo").orderBy("df", "word")
    ranked = each.join(df, "word").withColumn("rest", F.col("size") - F.row_number().over(rare_first) + 1).where(F.col("rest") >= F.ceil(F.col("size") / 2))
    slots = own.groupBy("head", F.floor(F.col("at") / (DAYS * DAY)).alias("slot")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    rows = written(ranked.join(slots, "head"))
    early = rows.select("word", F.col("head").alias("a"), F.col("repo").alias("repo_a"), F.col("size").alias("size_a"), F.col("rest").alias("rest_a"), "last", F.col("slot").alias("from"), F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    late = rows.select("word", F.col("head").alias("b"), F.col("repo").alias("repo_b"), F.col("size").alias("size_b"), F.col("rest").alias("rest_b"), "first", "slot")
    near = (F.col("slot") > F.col("from")) & (F.col("first") - F.col("last") <= DAYS * DAY) | (F.col("slot") == F.col("from")) & (F.col("a") < F.col("b"))
    enough = F.least("rest_a", "rest_b") * 3 >= F.col("size_a") + F.col("size_b")
    pairs = early.join(late, ["word", "slot"]).where(near & enough & (F.col("a") != F.col("b"))).where("repo_a IS NULL OR repo_b IS NULL OR repo_a = repo_b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bag = lambda c: stretch.select(F.col("head").alias(c), F.col("words").alias(f"{c}_words"))
    both = pairs.join(bag("a"), "a").join(bag("b"), "b").where(F.size(F.array_intersect("a_words", "b_words")) * 2 >= F.size(F.array_union("a_words", "b_words")))
    return star.union(both.select("a", "b"))


def group_work(sessions: DataFrame, said: DataFrame, edits: DataFrame, commits: DataFrame, items: DataFrame, stop: tuple[str, ...] = STOP) -> Tasks:
    """Tasks of sessions (id, repo, branch, title, started, updated), what they say (id, key, n), their edits (id, path), commits (repo,
    sha, at, subject, mine) and items (id, key, branch, title, text, at, pr, mine); times in seconds.

    Ticket keys count if their project is that of an item or in a branch's name. A feature branch ties its sessions and its keys,
    unless it has over LONG_SESSIONS sessions or spans over LONG_DAYS. A key in a session's title or branch ties it; else the key
    it says most, of TEXT_KEYS at most, if its repository is a home of the key (named there by a title, branch or commit) or of the
    key's project, or the key has none. Sessions are tied by `same_files` and `same_topic`, commits by keys in their
    subject, items by their branch and key, or without a key by the first ITEM_KEYS keys of their text. A component without
    session, ticket or pull request is no task, nor are tickets alone that aren't the user's. Null repositories and keys tie nothing.
    """
    s = written(sessions.select("id", F.nullif("repo", F.lit("")).alias("repo"), F.coalesce("branch", F.lit("")).alias("branch"), F.coalesce("title", F.lit("")).alias("title"), "started", F.col("updated").alias("at")))
    item_keys = items.where("key IS NOT NULL").select("key").distinct()
    prefixes = item_keys.select(_project(F.col("key")).alias("project")).union(s.select(F.explode(keys_of(F.col("branch"))).alias("k")).select(_project(F.col("k")))).distinct()
    prefixes = written(prefixes.where("project <> ''"))
    known = lambda rows: rows.withColumn("project", _project(F.col("key"))).join(prefixes, "project", "left_semi").drop("project")

    feature = s.where(F.col("repo").isNotNull() & ~F.col("branch").isin(*DEFAULT_BRANCHES))
    spans = feature.groupBy("repo", "branch").agg(F.count("*").alias("n"), (F.max("at") - F.min(F.coalesce("started", "at"))).alias("span"))
    short = written(spans.where((F.col("n") <= LONG_SESSIONS) & (F.col("span") <= LONG_DAYS * DAY)).select("repo", "branch"))
    branch_node = F.concat(F.lit("b:"), "repo", F.lit("@"), "branch")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    on_branch = feature.join(short, ["repo", "branch"]).select(node("s", "id").alias("a"), branch_node.alias("b"))
    upper = short.select("repo", "branch", F.explode(branch_keys(F.col("branch"))).alias("key"))
    on_key = upper.join(item_keys, "key", "left_semi").select(branch_node.alias("a"), node("t", "key").alias("b"))

    in_title = s.select("id", "repo", F.explode(keys_of(F.col("title"))).alias("key"))
    in_branch = s.select("id", "repo", F.explode(branch_keys(F.col("branch"))).alias("key")).join(item_keys, "key", "left_semi").select("id", "repo", "key")
    strong = written(known(in_title.unionByName(in_branch)).distinct())
    subject = written(known(commits.select("repo", "sha", "at", F.explode(keys_of(F.col("subject"))).alias("key"))))
    home = strong.where("repo IS NOT NULL").select("key", "repo").union(subject.select("key", "repo")).distinct()
    home = written(home)
    project_home = home.select(_project(F.col("key")).alias("project"), "repo").distinct()
    spoken = known(said.where("n > 0").groupBy("id", "key").agg(F.sum("n").alias("n"))).withColumn("all", F.count("*").over(Window.partitionBy("id")))
    weak = spoken.where(F.col("all") <= TEXT_KEYS).join(s.where("repo IS NOT NULL").select("id", "repo"), "id").join(strong.select("id").distinct(), "id", "left_anti").withColumn("project", _project(F.col("key")))
    mark = lambda rows, name, *c: rows.select(*c).distinct().withColumn(name, F.lit(True))
    weak = weak.join(mark(home, "own", "key", "repo"), ["key", "repo"], "left").join(mark(home, "any_own", "key"), "key", "left")
    weak = weak.join(mark(project_home, "near", "project", "repo"), ["project", "repo"], "left").join(mark(project_home, "any_near", "project"), "project", "left")
    at_home = F.col("own") | (F.col("any_own").isNull() & (F.col("near") | F.col("any_near").isNull()))
    picked = weak.where(at_home).groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("less"), "key"))["key"].alias("key"))
    names = strong.select("id", "key").union(picked.select("id", "key")).select(node("s", "id").alias("a"), node("t", "key").alias("b"))

    pairs = same_files(s, edits).union(topic_links(s, stop)).select(node("s", "a").alias("a"), node("s", "b").alias("b"))
    committed = subject.select(node("c", "sha").alias("a"), node("t", "key").alias("b"))
    opened = items.join(short, "branch").select(node("i", "id").alias("a"), branch_node.alias("b"))
    own_key = items.where("key IS NOT NULL").select(node("i", "id").alias("a"), node("t", "key").alias("b"))
    texts = items.where("key IS NULL").select("id", F.posexplode(keys_of(F.col("text"))).alias("nth", "key"))
    texts = known(texts).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("nth"))).where(F.col("r") <= ITEM_KEYS)
    in_text = texts.select(node("i", "id").alias("a"), node("t", "key").alias("b"))
    alone = s.select(node("s", "id").alias("a")).union(items.select(node("i", "id"))).select("a", F.col("a").alias("b"))
    edges = on_branch
    for more in (on_key, names, pairs, committed, opened, own_key, in_text, alone):
        edges = edges.union(more)
    members = written(group(written(edges.distinct())).select(F.col("component").alias("task"), "node"))

    kind, name = F.substring("node", 1, 1), F.expr("substring(node, 3)")
    facts = members.select("task", "node", kind.alias("kind"), name.alias("name"))
    of = lambda k: facts.where(F.col("kind") == k).select("task", "name")
    held = of("s").join(s.select(F.col("id").cast("string").alias("name"), "at", "title"), "name").select("task", F.lit("s").alias("kind"), "name", "at", "title", F.lit(False).alias("pr"), F.lit(True).alias("mine"))
    things = of("i").join(items.select(F.col("id").cast("string").alias("name"), "at", "title", "key", F.coalesce("pr", F.lit(False)).alias("pr"), F.coalesce("mine", F.lit(False)).alias("mine")), "name")
    things = things.select("task", F.when(F.col("key").isNotNull(), "k").otherwise("i").alias("kind"), "name", "at", "title", "pr", "mine")
    done = of("c").join(commits.select(F.col("sha").alias("name"), "at", F.coalesce("mine", F.lit(False)).alias("mine")).dropDuplicates(["name"]), "name").select("task", F.lit("c").alias("kind"), "name", "at", F.lit(None).cast("string").alias("title"), F.lit(False).alias("pr"), "mine")
    branches_ = of("b").select("task", F.lit("b").alias("kind"), "name", F.lit(0).cast("long").alias("at"), F.substring_index("name", "@", -1).alias("title"), F.lit(False).alias("pr"), F.lit(True).alias("mine"))
    tickets = of("t").select("task", F.lit("t").alias("kind"), "name", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("pr"), F.lit(False).alias("mine"))
    rows = held.unionByName(things).unionByName(done).unionByName(branches_).unionByName(tickets)
    is_ = lambda k: F.col("kind") == k
    newest = lambda when: F.max_by(F.when(when, F.col("title")), F.when(when, F.struct("at", "name")))
    cards = rows.groupBy("task").agg(
        F.coalesce(newest(is_("k")), F.when(F.count_if(is_("s")) == 0, newest(F.col("pr"))), F.min(F.when(is_("b"), F.col("title"))), newest(is_("s")), newest(F.col("pr"))).alias("title"),
        F.max("at").alias("updated"), F.count_if(is_("s")).alias("sessions"), F.sort_array(F.collect_set(F.when(is_("t"), F.col("name")))).alias("tickets"),
        F.sort_array(F.collect_set(F.when(is_("b"), F.col("name")))).alias("branches"), F.count_if(is_("c")).alias("commits"), F.count_if(is_("k") | is_("i")).alias("items"),
        F.count_if(is_("k")).alias("keyed"), F.bool_or("pr").alias("has_pr"), F.bool_or("mine").alias("is_mine"),
    )
    cards = cards.where("(sessions > 0 OR keyed > 0 OR has_pr) AND (sessions > 0 OR size(branches) > 0 OR keyed = 0 OR is_mine)").drop("keyed", "has_pr", "is_mine")
    return Tasks(members.join(cards.select("task"), "task", "left_semi"), cards)
