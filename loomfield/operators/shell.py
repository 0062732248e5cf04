"""Writes to branches and pull requests that a session made from its shell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Branches that are nobody's own.
GENERIC = ("main", "master", "develop", "dev", "HEAD")
_GIT = r"\bgit (?:-C \S+ )?"
_NAME = r"(\w[\w./-]*)"
#: Fixed patterns of commands; where a group is, it holds the branch, number, repository or folder.
PUSH = _GIT + r"push\b[^\n;&|]*?\borigin\s+(?:HEAD:)?" + _NAME
PUSH_BARE = _GIT + r"push\b(?![^\n;&|]*\borigin\s+\w[\w./-]*)"
CHECKOUT_NEW = _GIT + r"(?:checkout -[bB]|switch -[cC])\s+" + _NAME
CHECKOUT = _GIT + r"(?:checkout|switch)\s+" + _NAME + r"\s*(?:$|[;&|])"
COMMIT = _GIT + r"commit\b"
PR_CREATE = r"\bgh pr create\b"
PR_MERGE = r"\bgh pr merge\s+(\d+)"
PR_URL = r"https://github\.com/([\w.-]+/[\w.-]+)/pull/(\d+)"
REPO_FLAG = r"(?:-R|--repo)\s+([\w.-]+/[\w.-]+)"
CD = r"\bcd\s+(\S+)"
HEREDOC = r"(?s)<<-?\s*(['\"]?)(\w+)\1[^\n]*\n.*?\n\s*\2\s*(?:\n|$)"
#: Quoted text that doesn't follow -c, or what is between, or a lone quote.
TOKENS = r"""((?<!-c )(?<!-c)(?:"(?:[^"\\\n]|\\.)*"|'[^'\n]*')|[^"']+|["'])"""


def shell_code(command: Column) -> Column:
    """A command without bodies of here-documents and without quoted text that only names git or gh; text after -c is code and stays."""
    bare = F.regexp_replace(command, HEREDOC, "\n")
    # Quoted text must be taken in turn from the left, or what is between two quoted texts would count as quoted.
    tokens = F.regexp_extract_all(bare, F.lit(TOKENS), F.lit(1))
    quoted = lambda t: (F.length(t) > 1) & F.substring(t, 1, 1).isin("'", '"') & t.rlike(r"\b(?:git|gh) ")
    return F.array_join(F.transform(tokens, lambda t: F.when(quoted(t), '""').otherwise(t)), "")


def shell_edges(calls: DataFrame, origins: DataFrame) -> DataFrame:
    """(session, seq, kind, key, evidence) of calls (session, seq, command, result, cwd, branch) in the order of seq.

    A session's folder is the last that a call recorded, or before any that the first `cd` went to; its branch is the last
    checked out, else the one recorded with the call. Both are carried along a window of the session's calls. `origins` (folder,
    repo) names folders' repositories; without one, a branch stands alone and a merge needs its --repo. A push or commit whose
    result speaks of an error at its start doesn't count. Null commands and results are empty; repeated calls count each.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    all_of = lambda pattern: F.regexp_extract_all("code", F.lit(pattern), F.lit(1))
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = calls.select("session", "seq", shell_code(F.coalesce("command", F.lit(""))).alias("code"), F.coalesce("result", F.lit("")).alias("result"), blank("cwd").alias("cwd"), blank("branch").alias("recorded"))
    known = known.withColumns({
        "folder": F.coalesce(F.last("cwd", ignorenulls=True).over(so_far), F.first(F.nullif(F.regexp_extract("code", CD, 1), F.lit("")), ignorenulls=True).over(earlier)),
        "created": all_of(CHECKOUT_NEW), "switched": all_of(CHECKOUT), "pushed": all_of(PUSH),
    })
    moved = F.coalesce(F.try_element_at("created", F.lit(-1)), F.try_element_at("switched", F.lit(-1)))
    known = known.withColumn("on", F.coalesce(F.last(moved, ignorenulls=True).over(so_far), "recorded"))
    known = known.join(origins.select("folder", "repo").dropDuplicates(["folder"]), "folder", "left")
    branch_key = lambda name: F.concat_ws("@", blank("repo"), name)
    own = lambda name: ~name.isin(*GENERIC)
    edge = lambda kind, key, evidence: F.struct(F.lit(kind).alias("kind"), key.alias("key"), evidence.alias("evidence"))
    fine = ~F.substring(F.lower("result"), 1, 200).contains("error")
    here = own(F.col("on")) & fine
    none = F.array().cast("array<struct<kind:string,key:string,evidence:string>>")
    one = lambda when, item: F.when(when, F.array(item)).otherwise(none)
    made = F.regexp_extract("result", PR_URL, 1)
    target = F.coalesce(F.nullif(F.regexp_extract("code", REPO_FLAG, 1), F.lit("")), blank("repo"))
    edges = F.concat(
        F.transform(F.filter("created", own), lambda b: edge("branch", branch_key(b), F.concat(F.lit("created "), b))),
        F.transform(F.filter("pushed", own), lambda b: edge("branch", branch_key(b), F.concat(F.lit("git push "), b))),
        one(here & (F.size("pushed") == 0) & F.col("code").rlike(PUSH_BARE), edge("branch", branch_key(F.col("on")), F.concat(F.lit("git push "), "on"))),
        one(here & F.col("code").rlike(COMMIT), edge("branch", branch_key(F.col("on")), F.lit("git commit"))),
        one((made != "") & F.col("code").rlike(PR_CREATE), edge("pr", F.concat(made, F.lit("#"), F.regexp_extract("result", PR_URL, 2)), F.lit("gh pr create"))),
        F.when(target.isNotNull(), F.transform(all_of(PR_MERGE), lambda n: edge("pr", F.concat(target, F.lit("#"), n), F.lit("gh pr merge")))).otherwise(none),
    )
    return known.select("session", "seq", F.explode(edges).alias("e")).select("session", "seq", "e.kind", "e.key", "e.evidence")


def mentions(links: DataFrame) -> DataFrame:
    """(session, kind, key) that a session's text names once or more, of links (session, kind, key); plain urls don't count."""
    return links.where(F.col("kind").isin("branch", "pr", "ticket")).select("session", "kind", "key").distinct()
