"""What became of branches: merged, squashed into one commit, applied anew, or still open; and what to do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_DAYS = 14


def change_ids(changes: DataFrame, *by: str) -> DataFrame:
    """(by..., one, two): what the changed lines (path, sign, line) of a commit amount to, whatever their line numbers.

    Each line that goes in adds two hashes of its path and text without white space, each that goes out takes them away. So
    the sum of several commits is that of their whole change as one difference, in which a line that came and went again isn't
    seen, and a commit equals a branch if the sums are equal. Order of files and lines doesn't count. Null lines count as empty.
    """
    bare = F.regexp_replace(F.coalesce("line", F.lit("")), r"\s+", "")
    h = lambda salt: F.col("sign").cast("decimal(2,0)") * F.xxhash64(F.lit(salt), F.col("path"), bare).cast("decimal(20,0)")
    sums = changes.groupBy(*by).agg(F.sum(h("one")).alias("one"), F.sum(h("two")).alias("two"))
    return sums.where("one <> 0 OR two <> 0")


def branch_states(commits: DataFrame, changes: DataFrame, base: DataFrame) -> DataFrame:
    """(repo, branch, commits, state, squashed_at, last) of branches whose own commits are (repo, branch, seq, sha, at).

    `changes` are (repo, sha, path, sign, line) of all commits, `base` the default branch's (repo, sha, at). States: `merged`, all
    its commits are in base; `squashed`, its whole change is one commit there, no older than its first; `rebased`, each of its
    changes is; `partly`, the change of its first commits (the most, in squashed_at) is one commit, but it went on; else `open`.
    A commit without changes counts for `merged` only; a branch of such commits is `open` if they aren't in base. A branch is one group of its commits' sums, never of lines.
    """
    ids = change_ids(changes, "repo", "sha")
    own = commits.join(base.select("repo", "sha", F.lit(True).alias("in_base")).dropDuplicates(["repo", "sha"]), ["repo", "sha"], "left")
    own = own.join(ids, ["repo", "sha"], "left").withColumns({"in_base": F.coalesce("in_base", F.lit(False)), "own_one": F.col("one"), "own_two": F.col("two")})
    so_far = Window.partitionBy("repo", "branch").orderBy("seq")
    whole = Window.partitionBy("repo", "branch")
    own = own.withColumns({
        "one": F.sum(F.coalesce("one", F.lit(0))).over(so_far), "two": F.sum(F.coalesce("two", F.lit(0))).over(so_far),
        "nth": F.row_number().over(so_far), "n": F.count("*").over(whole), "began": F.min("at").over(whole),
    })
    known = base.select("repo", "sha", "at").join(ids, ["repo", "sha"]).groupBy("repo", "one", "two").agg(F.max("at").alias("base_at"))
    single = known.select("repo", F.col("one").alias("own_one"), F.col("two").alias("own_two"), F.col("base_at").alias("single_at"))
    both = own.join(known, ["repo", "one", "two"], "left").join(single, ["repo", "own_one", "own_two"], "left")
    in_one = F.coalesce(F.col("base_at") >= F.col("began"), F.lit(False))
    out = both.groupBy("repo", "branch").agg(
        F.max("n").alias("commits"),
        F.bool_and("in_base").alias("merged"),
        F.bool_or(in_one & (F.col("nth") == F.col("n"))).alias("squashed"),
        F.coalesce(F.bool_and(F.when(F.col("own_one").isNotNull(), F.coalesce(F.col("single_at") >= F.col("began"), F.lit(False)))), F.lit(False)).alias("rebased"),
        F.max(F.when(in_one, F.col("nth"))).alias("squashed_at"),
        F.max("at").alias("last"),
    )
    state = F.when(F.col("merged"), "merged").when(F.col("squashed"), "squashed").when(F.col("rebased"), "rebased").when(F.col("squashed_at").isNotNull(), "partly").otherwise("open")
    return out.select("repo", "branch", "commits", state.alias("state"), F.when(state.isin("squashed", "partly"), F.col("squashed_at")).alias("squashed_at"), "last")


def branch_verdicts(states: DataFrame, checked_out: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """`states` with idle_days and a verdict: remove, review or keep; branches of `checked_out` (repo, branch) are kept."""
    held = states.join(checked_out.select("repo", "branch", F.lit(True).alias("held")).distinct(), ["repo", "branch"], "left")
    idle = F.date_diff(now, "last")
    busy = F.coalesce("held", F.lit(False)) | (idle < days)
    verdict = F.when(busy | F.col("state").isin("open", "partly"), "keep").when(F.col("state") == "merged", "remove").otherwise("review")
    return held.select("repo", "branch", "commits", "state", "squashed_at", idle.alias("idle_days"), verdict.alias("verdict"))


def worktree_verdicts(trees: DataFrame, sessions: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """(path, idle_days, verdict, why) of linked worktrees (path, here, locked, last_commit, uncommitted, ahead, pushed).

    The last use is the newest of its last commit and of `sessions` (cwd, updated) in it or below it, found through the folders
    above each session's.
    """
    from loomfield.functions.text import ancestors

    used = sessions.select("updated", F.explode(F.array_union(ancestors(F.col("cwd")), F.array("cwd"))).alias("path"))
    last = trees.select("path").join(used, "path").groupBy("path").agg(F.max("updated").alias("last_session"))
    rows = trees.join(last, "path", "left").withColumn("idle_days", F.date_diff(now, F.greatest("last_commit", "last_session")))
    dirty, unpushed = F.col("uncommitted") > 0, (F.col("ahead") > 0) & ~F.col("pushed")
    why = F.concat_ws(", ", F.when(dirty, "uncommitted changes"), F.when(unpushed, "commits not merged or pushed"), F.when(F.col("locked"), "locked"))
    verdict = F.when(~F.col("here"), "remove").when(F.col("idle_days") < days, "keep").when(dirty | unpushed | F.col("locked"), "review").otherwise("remove")
    reason = F.when(~F.col("here"), "its folder is gone").when(F.col("idle_days") < days, "in use").when(verdict == "review", why).when(F.col("ahead") > 0, "clean, pushed").otherwise("clean, in the default branch")
    return rows.select("path", "idle_days", verdict.alias("verdict"), reason.alias("why"))
