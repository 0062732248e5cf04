"""Work threads: anchors, states, claims, branches and what others did near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import ancestors
from loomfield.operators.rounds import written


def thread_state(sinks: DataFrame, thread: str, now: Column, loose_days: int = 3) -> DataFrame:
    """(thread, state): done if every sink is, open while one moved within `loose_days`, else loose ends."""
    own = sinks.groupBy(thread).agg(F.bool_and("done").alias("done"), F.max("at").alias("at"))
    fresh = F.col("at") >= now - F.make_dt_interval(F.lit(loose_days))
    return own.select(thread, F.when(F.col("done"), "done").when(fresh, "open").otherwise("loose ends").alias("state"))


def with_override(states: DataFrame, manual: DataFrame, thread: str) -> DataFrame:
    """A manual state wins while nothing newer happened: manual.at >= at."""
    last = manual.groupBy(thread).agg(F.max_by("state", "at").alias("_state"), F.max("at").alias("_at"))
    return states.join(last, thread, "left").withColumn("state", F.when(F.col("_at") >= F.col("at"), F.col("_state")).otherwise(F.col("state"))).drop("_state", "_at")


def anchors(candidates: DataFrame, thread: str, precedence: tuple[str, ...]) -> DataFrame:
    """(thread, kind, ref): the first kind by precedence, the least ref within it."""
    place = F.lit(len(precedence))
    for k in reversed(range(len(precedence))):
        place = F.when(F.col("kind") == precedence[k], k).otherwise(place)
    return candidates.groupBy(thread).agg(F.min(F.struct(place.alias("p"), "ref", "kind")).alias("m")).select(thread, "m.kind", "m.ref")


def claims(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """(file, session, n, share, holds): surviving lines of a file by the newest session that wrote each; ties to the later id."""
    newest = lines.join(sessions.select("session", "updated"), "session").groupBy("file", "line").agg(F.max_by("session", F.struct("updated", "session")).alias("session"))
    own = newest.groupBy("file", "session").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file")
    rows = own.withColumns({"share": F.col("n") / F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), F.desc("session")))})
    return rows.withColumn("holds", F.col("r") == 1).drop("r")


def integrated(branch_commits: DataFrame, default_commits: DataFrame) -> DataFrame:
    """(branch, merged, pr): whether every commit is on the default branch, by sha or by patch; the pull request named there."""
    main = default_commits.select("sha", "patch", F.regexp_extract("subject", r"(?:#|pull request #)(\d+)", 1).alias("pr"))
    by_sha = branch_commits.join(main.select("sha", F.col("pr").alias("p1")).dropDuplicates(["sha"]), "sha", "left")
    both = by_sha.join(main.select("patch", F.col("pr").alias("p2")).dropDuplicates(["patch"]), "patch", "left")
    found = F.col("p1").isNotNull() | F.col("p2").isNotNull()
    return both.groupBy("branch").agg(F.bool_and(found).alias("merged"), F.max(F.nullif(F.coalesce("p1", "p2"), F.lit(""))).alias("pr"))


def idle_branches(branches: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """`verdict` of branches (branch, merged, last): delete, stale or keep."""
    idle = F.date_diff(now, "last")
    return branches.withColumn("idle_days", idle).withColumn("verdict", F.when(F.col("merged"), "delete").when(idle > days, "stale").otherwise("keep"))


def coworkers(touched: DataFrame, commits: DataFrame, now: Column, days: int = 21) -> DataFrame:
    """(task, author, commits, last): others' commits in a task's folders of the last `days`."""
    folders = touched.select("task", "me", "folder").distinct()
    recent = commits.where(F.col("at") >= now - F.make_dt_interval(F.lit(days))).select("sha", "author", "at", F.explode(ancestors(F.col("path"))).alias("folder"))
    counted = [F.count("*").alias("commits"), F.max("at").alias("last")]
    # Tasks with the same folders have the same commits near them: these are counted once for all such tasks.
    tasks = folders.where("me IS NOT NULL").groupBy("task").agg(F.min("me").alias("me"), F.max("me").alias("_most"), F.array_sort(F.collect_set("folder")).alias("folders"))
    one = tasks.where("me = _most")
    near = one.select("folders").distinct().select("folders", F.explode("folders").alias("folder")).join(recent, "folder").select("folders", "author", "sha", "at").distinct()
    # What is shuffled is small, what leaves the join is not, so its number of tasks is given.
    parts = 8 * touched.sparkSession.sparkContext.defaultParallelism
    near = near.groupBy("folders", "author").agg(*counted).repartition(parts, "folders")
    shared = one.repartition(parts, "folders").join(near.hint("merge"), "folders").where("author <> me").select("task", "author", "commits", "last")
    # A task of several people leaves out each one's own commits in that one's folders only.
    several = folders.join(tasks.where("me <> _most").select("task"), "task", "left_semi")
    rows = several.join(recent, "folder").where("author <> me").select("task", "author", "sha", "at").distinct()
    return shared.unionByName(rows.groupBy("task", "author").agg(*counted))


def session_repo(touches: DataFrame, cwd: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(session, repo): the repo of its folder, else the one with `least` files and `share` of those it touched."""
    own = touches.groupBy("session", "repo").agg(F.count_distinct("file").alias("n"))
    total = own.withColumn("t", F.sum("n").over(Window.partitionBy("session")))
    best = total.where((F.col("n") >= least) & (F.col("n") >= share * F.col("t"))).groupBy("session").agg(F.max_by("repo", F.struct("n", "repo")).alias("touched"))
    return cwd.select("session", F.col("repo").alias("cwd")).join(best, "session", "full_outer").select("session", F.coalesce("cwd", "touched").alias("repo"))


def git_writes(calls: DataFrame, session: str = "session", order: str = "line", command: str = "command") -> DataFrame:
    """(session, line, branch, folder): commits and pushes with the branch and folder that earlier calls set."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    branch = F.nullif(F.regexp_extract(command, r"\b(?:checkout|switch)(?: -[bBcC])? ([\w./-]+)", 1), F.lit(""))
    folder = F.nullif(F.regexp_extract(command, r"\bcd ([\w./~-]+)", 1), F.lit(""))
    rows = calls.withColumns({"branch": F.last(branch, True).over(w), "folder": F.last(folder, True).over(w)})
    return rows.where(F.col(command).rlike(r"\bgit (?:-C \S+ )?(?:commit|push)\b")).select(session, order, "branch", "folder")


def purge(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of sources that are on."""
    return rows.join(sources.where("status = 'on'").select("source"), "source", "left_semi")


def due(sources: DataFrame, now: Column, every_seconds: int) -> DataFrame:
    """Sources never collected or collected longer ago than `every_seconds`, the oldest first."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col("collected_at").cast("timestamp"))
    return sources.where(F.col("collected_at").isNull() | (age >= every_seconds)).orderBy(F.col("collected_at").asc_nulls_first(), "source")


def apply_claims(members: DataFrame, holders: DataFrame) -> DataFrame:
    """`members` (thread, branch) of branches that another thread holds go; those stay as `contributed`."""
    own = members.join(holders.select("branch", "holder"), "branch", "left")
    return own.withColumn("contributed", F.col("holder").isNotNull() & (F.col("holder") != F.col("thread"))).drop("holder")


def related(sinks: DataFrame, files: DataFrame, top: int = 5) -> DataFrame:
    """(a, b, reason): cards that share a sink, then cards that share files; one reason a pair, the `top` of each card."""
    named = lambda rows, key, c: rows.select(key, F.col("card").alias(c))
    pairs = lambda mine, rows, key, why, rank: mine.join(named(rows, key, "b"), key).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", F.lit(why).alias("reason"), F.lit(rank).alias("p"), "n")
    sinks, files = sinks.distinct(), files.distinct()
    first = Window.partitionBy("a").orderBy("p", F.desc("n"), "b")
    by_sink = pairs(named(sinks, "sink", "a"), sinks, "sink", "sink", 0).withColumn("r", F.row_number().over(first)).where(F.col("r") <= top)
    by_sink = written(by_sink.select("a", "b", "reason", "p", "n", "r"))
    # Sinks go before files, so a card with `top` others by sinks needs no pair by files.
    full = by_sink.where(F.col("r") == top).select("a")
    by_file = pairs(named(files, "file", "a").join(full, "a", "left_anti"), files, "file", "files", 1).join(by_sink.select("a", "b"), ["a", "b"], "left_anti")
    ranked = by_sink.drop("r").unionByName(by_file).withColumn("r", F.row_number().over(first))
    return ranked.where(F.col("r") <= top).select("a", "b", "reason")


def project_groups(items: DataFrame, sources: tuple[str, ...] = ("parent", "linear", "component", "milestone")) -> DataFrame:
    """(item, project): the first grouping that an item has; items without one stand alone."""
    named = [F.concat(F.lit(f"{s}:"), F.col(s).cast("string")) for s in sources]
    return items.select("item", F.coalesce(*named, F.concat(F.lit("item:"), F.col("item").cast("string"))).alias("project"))


def my_messages(turns: DataFrame, session: str = "conv_id", turn: str = "turn", last: int = 3, least: int = 20) -> DataFrame:
    """(session, turn, text): the last substantive user turns."""
    own = turns.where((F.col("role") == "user") & (F.length(F.trim("text")) >= least))
    return own.withColumn("r", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))).where(F.col("r") <= last).select(session, turn, "text")


def last_reply(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(session, reply, question): the first agent turn after the last user turn, and its last question."""
    asked = turns.where("role = 'user'").groupBy(session).agg(F.max(turn).alias("asked"))
    after = turns.where("role = 'assistant'").join(asked, session).where(F.col(turn) > F.col("asked"))
    reply = after.groupBy(session).agg(F.min_by("text", turn).alias("reply"))
    return reply.withColumn("question", F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all("reply", F.lit(r"([^.?!\n]+\?)"), F.lit(1))), -1))


def attention(rows: DataFrame, now: Column, active_hours: int = 24) -> DataFrame:
    """`active` and `reasons` of cards (at, state, n_open)."""
    active = F.col("at") >= now - F.make_dt_interval(F.lit(0), F.lit(active_hours))
    tags = F.array(F.when(active, "active"), F.when(F.col("state") == "close", "review"), F.when(F.col("n_open") == 1, "one left"))
    return rows.withColumns({"active": active, "reasons": F.array_compact(tags)})
