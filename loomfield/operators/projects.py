"""Projects: groups of tickets with the pull requests, branches, commits and cards that tie to each, seen by one person.

Inputs, one row each (times are timestamps):

- tickets: key, title, state (todo, progress, close, done), updated, parent, linear, component; links: a, b
- assignees: key, person
- pulls: url, repo, title, head, body, state (draft, open, review, merged, closed), author, milestone, updated; reviewers: url, person
- branches: ref, name, author, updated
- commits: ref, author, subject, at
- card_keys: card, key, updated; card_pulls: card, url
- closeness: person, closeness to the viewer `me`

A null in a key, address or person takes part in nothing; null texts are empty. Repeated rows count once. Items that share a
pull request, branch or card meet at that node; pairs of them are never made. Where the most frequent one is asked for, ties go
to the least name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.operators.linkage import _cut, group
from loomfield.operators.search import best_per_key
from loomfield.operators.tasks import keys_of

#: Fixed values.
PREFIX = r"^\s*(?:\[([^\]]{2,40})\]|([A-Za-z][\w .&/-]{1,30}):\s)"
ROLES = {"author": 3.0, "assignee": 3.0, "committer": 2.0, "reviewer": 1.5, "context": 1.0}
BODY_KEYS, PREFIX_TICKETS, CLOSE_AUTHOR, HALF_LIFE = 3, 60, 0.25, 10


@dataclass
class Projects:
    """ties (ticket, kind, ref), tickets (ticket, title, state, updated, kind, project), members (kind, project, person, roles, closeness), projects."""

    ties: DataFrame
    tickets: DataFrame
    members: DataFrame
    projects: DataFrame


def prefix_of(title: Column) -> Column:
    """"[On-call] Disk full" gives on-call, "Billing: retry" gives billing; empty without one."""
    part = lambda n: F.regexp_extract(F.coalesce(title, F.lit("")), PREFIX, n)
    return F.lower(F.trim(F.when(part(1) != "", part(1)).otherwise(part(2))))


def _space(key: Column) -> Column:
    return F.substring_index(key, "-", 1)


def ties(tickets: DataFrame, pulls: DataFrame, branches: DataFrame, commits: DataFrame, card_keys: DataFrame, card_pulls: DataFrame) -> DataFrame:
    """(ticket, kind, ref) for keys in titles, heads, bodies with three keys at most, branch names and subjects, and on cards.

    A key counts only if a ticket or a card has one with its prefix. A card that has a key and a pull request ties the two.
    """
    spaces = tickets.select(_space(F.col("key")).alias("space")).union(card_keys.select(_space(F.col("key")))).where("space IS NOT NULL").distinct()

    def named(rows: DataFrame, ref: str, text: str, kind: str) -> DataFrame:
        found = rows.where(F.col(ref).isNotNull()).select(F.explode(keys_of(F.col(text))).alias("ticket"), F.col(ref).alias("ref"))
        return found.withColumn("space", _space(F.col("ticket"))).join(spaces, "space", "left_semi").select("ticket", F.lit(kind).alias("kind"), "ref").distinct()

    body = named(pulls, "url", "body", "pr_body")
    few = body.groupBy("ref").agg(F.count("*").alias("n")).where(F.col("n") <= BODY_KEYS)
    held = card_keys.where("key IS NOT NULL AND card IS NOT NULL")
    both = held.join(card_pulls.where("url IS NOT NULL"), "card").join(pulls.select("url"), "url", "left_semi")
    parts = [
        named(pulls, "url", "title", "pr_title"), named(pulls, "url", "head", "pr_branch"), body.join(few.select("ref"), "ref", "left_semi").select("ticket", "kind", "ref"),
        named(branches, "ref", "name", "branch_name"), named(commits, "ref", "subject", "commit"),
        held.select(F.col("key").alias("ticket"), F.lit("card").alias("kind"), F.col("card").alias("ref")),
        both.select(F.col("key").alias("ticket"), F.lit("card").alias("kind"), F.col("url").alias("ref")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def with_unlisted(tickets: DataFrame, tied: DataFrame, pulls: DataFrame, commits: DataFrame, me: str) -> DataFrame:
    """The tickets, and those that only a key names; keys of commits alone count if `me` wrote one of them.

    Such a ticket is `todo`, without an update, titled by a pull request that names it, else by its key.
    """
    own = commits.where(F.col("author") == me).select("ref")
    strong = tied.where("kind <> 'commit'").unionByName(tied.where("kind = 'commit'").join(own, "ref", "left_semi").select(*tied.columns))
    new = strong.select(F.col("ticket").alias("key"), "ref").join(tickets.select("key"), "key", "left_anti")
    titles = pulls.select(F.col("url").alias("ref"), "title")
    new = new.join(titles, "ref", "left").groupBy("key").agg(F.min(F.when(F.col("title") != "", F.col("title"))).alias("title"))
    new = new.select("key", F.coalesce("title", "key").alias("title"), F.lit("todo").alias("state"))
    return tickets.withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("key"))).unionByName(new, allowMissingColumns=True)


def states(tickets: DataFrame, tied: DataFrame, pulls: DataFrame, branches: DataFrame, commits: DataFrame, card_keys: DataFrame, now: Column, days: int = 120) -> DataFrame:
    """Tickets with activity in the last `days`: `updated` is the latest of anything that ties, `state` follows the pull requests.

    Done stays done. Merged and none open: done. One in review: close. One open or a draft: progress. Else the ticket's own
    state, but a branch lifts todo to progress.
    """
    is_pr = lambda *s: F.count_if(F.col("pr_state").isin(*s))
    refs = pulls.select(F.col("url").alias("ref"), F.col("state").alias("pr_state"), F.col("updated").alias("at"), F.lit(0).alias("branch"))
    refs = refs.unionByName(branches.select("ref", F.lit(None).cast("string").alias("pr_state"), F.col("updated").alias("at"), F.lit(1).alias("branch")))
    refs = refs.unionByName(commits.select("ref", F.lit(None).cast("string").alias("pr_state"), "at", F.lit(0).alias("branch")))
    near = tied.select("ticket", "ref").distinct().join(refs, "ref")
    sums = near.groupBy("ticket").agg(is_pr("merged").alias("merged"), is_pr("review").alias("review"), is_pr("review", "open", "draft").alias("open"), F.max("branch").alias("branch"), F.max("at").alias("tied_at"))
    held = card_keys.groupBy(F.col("key").alias("ticket")).agg(F.max("updated").alias("held_at"))
    rows = tickets.withColumnRenamed("key", "ticket").join(sums, "ticket", "left").join(held, "ticket", "left").fillna(0, ["merged", "review", "open", "branch"])
    state = (
        F.when(F.col("state") == "done", "done").when((F.col("merged") > 0) & (F.col("open") == 0), "done").when(F.col("review") > 0, "close").when(F.col("open") > 0, "progress")
        .when((F.col("branch") > 0) & (F.coalesce("state", F.lit("todo")) == "todo"), "progress").otherwise(F.coalesce("state", F.lit("todo")))
    )
    rows = rows.withColumns({"state": state, "updated": F.greatest("updated", "tied_at", "held_at")})
    return rows.where(F.col("updated") >= now - F.expr(f"INTERVAL {days} DAYS")).select("ticket", "title", "state", "updated", "parent", "linear", "component")


def _most(rows: DataFrame, key: str, *names: str) -> DataFrame:
    """The `names` with the greatest `n` for each key, the least of them on ties."""
    return best_per_key(rows, key, [F.desc("n"), *map(F.col, names)]).select(key, *names)


def groups(tickets: DataFrame, tied: DataFrame, pulls: DataFrame, links: DataFrame) -> DataFrame:
    """(ticket, kind, project) of `states` rows.

    The service's own group first: the parent (which is in it too), a Linear project, a component, the milestone of most of its
    pull requests. Of the rest, a ticket whose title prefix is that of more than half of such a group joins it (of several, the
    one with most of them), then one that shares a pull request, branch or card joins the group that shares most. What is left is
    joined by links, shared references and prefixes of 2 to 60 tickets into components named by their least key.
    """
    parents = tickets.where("parent IS NOT NULL").select(F.col("parent").alias("ticket"), F.lit(True).alias("is_parent")).distinct()
    miles = tied.select("ticket", F.col("ref").alias("url")).distinct().join(pulls.where("milestone <> ''").select("url", "milestone"), "url")
    miles = _most(miles.groupBy("ticket", "milestone").agg(F.count("*").alias("n")), "ticket", "milestone")
    rows = tickets.join(parents, "ticket", "left").join(miles, "ticket", "left").withColumn("pre", prefix_of(F.col("title")))
    pick = lambda kind, ref: F.struct(F.lit(kind).alias("kind"), ref.alias("project"))
    own = (
        F.when(F.col("parent").isNotNull(), pick("parent", F.col("parent"))).when(F.col("is_parent"), pick("parent", F.col("ticket"))).when(F.col("linear").isNotNull(), pick("linear", F.col("linear")))
        .when(F.col("component").isNotNull(), pick("component", F.concat(_space(F.col("ticket")), F.lit("/"), "component"))).when(F.col("milestone").isNotNull(), pick("milestone", F.col("milestone")))
    )
    rows = _cut(rows.select("ticket", "pre", own.alias("g")).select("ticket", "pre", "g.*"))
    placed, rest = rows.where("kind IS NOT NULL"), rows.where("kind IS NULL").select("ticket", "pre")
    sizes = placed.groupBy("kind", "project").agg(F.count("*").alias("size"))
    major = placed.where("pre <> ''").groupBy("kind", "project", "pre").agg(F.count("*").alias("n")).join(sizes, ["kind", "project"]).where("n * 2 > size")
    by_prefix = _most(major, "pre", "kind", "project")
    near = tied.where("kind <> 'commit'").select("ticket", F.col("kind").alias("why"), "ref")
    there = near.select("ticket", "ref").distinct().join(placed, "ticket").groupBy("ref", "kind", "project").agg(F.count("*").alias("m"))
    shared = near.join(rest, "ticket", "left_semi").join(there, "ref").groupBy("ticket", "kind", "project").agg(F.sum("m").alias("n"))
    shared = _most(shared, "ticket", "kind", "project").select("ticket", F.col("kind").alias("k2"), F.col("project").alias("p2"))
    rest = rest.join(by_prefix, "pre", "left").join(shared, "ticket", "left")
    rest = _cut(rest.select("ticket", "pre", F.coalesce("kind", "k2").alias("kind"), F.when(F.col("kind").isNotNull(), F.col("project")).otherwise(F.col("p2")).alias("project")))
    joined, left = rest.where("kind IS NOT NULL"), rest.where("kind IS NULL").select("ticket", "pre")
    common = left.where("pre <> ''").groupBy("pre").agg(F.count("*").alias("n")).where(F.col("n").between(2, PREFIX_TICKETS))
    node = lambda kind, c: F.concat(F.lit(kind), c)
    is_left = left.select("ticket")
    edges = left.select(node("t", F.col("ticket")).alias("a"), node("t", F.col("ticket")).alias("b"))
    edges = edges.union(left.join(common, "pre", "left_semi").select(node("t", F.col("ticket")), node("p", F.col("pre"))))
    edges = edges.union(near.join(is_left, "ticket", "left_semi").select(node("t", F.col("ticket")), node("r", F.col("ref"))))
    edges = edges.union(links.join(is_left.withColumnRenamed("ticket", "a"), "a", "left_semi").join(is_left.withColumnRenamed("ticket", "b"), "b", "left_semi").select(node("t", F.col("a")), node("t", F.col("b"))))
    found = group(edges).where(F.col("node").startswith("t")).select(F.substring("node", 2, 1 << 30).alias("ticket"), "component")
    number = F.substring_index("ticket", "-", -1).cast("long")
    names = found.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(_space(F.col("ticket")).alias("s"), number.alias("i"), "ticket"))["ticket"].alias("project"))
    linked = found.join(names, "component").select("ticket", F.when(F.col("n") > 1, "linked").otherwise("ticket").alias("kind"), "project")
    return placed.select("ticket", "kind", "project").unionByName(joined.select("ticket", "kind", "project")).unionByName(linked)


def roles(tied: DataFrame, assignees: DataFrame, pulls: DataFrame, reviewers: DataFrame, branches: DataFrame, commits: DataFrame, me: str) -> DataFrame:
    """(ticket, person, role) with what ties to the ticket; `me` has context where a card holds it. Authors don't review their own."""
    at = tied.select("ticket", "kind", "ref").distinct()
    refs = at.select("ticket", "ref").distinct()
    wrote = pulls.select(F.col("url").alias("ref"), F.col("author").alias("person"))
    read = reviewers.select(F.col("url").alias("ref"), "person").join(wrote.withColumnRenamed("person", "by"), "ref").where(~F.col("person").eqNullSafe(F.col("by")))
    role = lambda rows, name: rows.select("ticket", "person", F.lit(name).alias("role"))
    out = role(assignees.withColumnRenamed("key", "ticket"), "assignee").unionByName(role(refs.join(wrote, "ref"), "author")).unionByName(role(refs.join(read, "ref"), "reviewer"))
    hands = branches.select("ref", F.col("author").alias("person")).unionByName(commits.select("ref", F.col("author").alias("person")))
    out = out.unionByName(role(refs.join(hands, "ref"), "committer"))
    return out.unionByName(role(at.where("kind = 'card'").withColumn("person", F.lit(me)), "context")).where("person IS NOT NULL").distinct()


def _weight(role: Column) -> Column:
    out = F.lit(0.0)
    for name, w in ROLES.items():
        out = F.when(role == name, w).otherwise(out)
    return out


def loose(tied: DataFrame, pulls: DataFrame, reviewers: DataFrame, card_pulls: DataFrame, closeness: DataFrame, me: str, now: Column, days: int = 120) -> DataFrame:
    """(url, kind, project) of recent pull requests without a ticket: by repository, those that `me` is on and those of close authors."""
    rows = pulls.where(F.col("updated") >= now - F.expr(f"INTERVAL {days} DAYS")).join(tied.select(F.col("ref").alias("url")), "url", "left_anti")
    on = reviewers.where(F.col("person") == me).select("url").union(card_pulls.select("url")).distinct().withColumn("on", F.lit(True))
    rows = rows.join(on, "url", "left").join(closeness.select(F.col("person").alias("author"), "closeness"), "author", "left")
    mine = F.coalesce("on", F.lit(False)) | F.coalesce(F.col("author") == me, F.lit(False))
    side = F.when(mine, "mine").when(F.col("closeness") >= CLOSE_AUTHOR, "team")
    return rows.where(side.isNotNull()).select("url", F.lit("pr").alias("kind"), F.concat_ws(":", "repo", side).alias("project"))


def build(tickets: DataFrame, links: DataFrame, assignees: DataFrame, pulls: DataFrame, reviewers: DataFrame, branches: DataFrame, commits: DataFrame, card_keys: DataFrame, card_pulls: DataFrame, closeness: DataFrame, me: str, now: Column, days: int = 120, stale_days: int = 21) -> Projects:
    """The project model for the viewer `me`.

    A project's score halves every 10 days since its last activity, times 0.4 + 0.6 x the viewer's involvement (the weight of their
    strongest role on each ticket, over 3, averaged) or, without the viewer, 0.15 + the mean closeness of the three closest members.
    It is likely done if all its tickets are, or all its pull requests are merged or closed, one merged, and no ticket is in work.
    """
    pulls, branches, commits = pulls.dropDuplicates(["url"]), branches.dropDuplicates(["ref"]), commits.dropDuplicates(["ref"])
    tickets, closeness = tickets.where("key IS NOT NULL").dropDuplicates(["key"]), closeness.dropDuplicates(["person"])
    since = now - F.expr(f"INTERVAL {days} DAYS")
    pulls = pulls.where(F.col("updated") >= since)
    tied = _cut(ties(tickets, pulls, branches.where(F.col("updated") >= since), commits.where(F.col("at") >= since), card_keys, card_pulls))
    rows = states(with_unlisted(tickets, tied, pulls, commits, me), tied, pulls, branches, commits, card_keys, now, days)
    rows = _cut(rows)
    rows = _cut(rows.join(groups(rows, tied, pulls, links), "ticket").select("ticket", "title", "state", "updated", "kind", "project"))
    key = ["kind", "project"]
    of = rows.select("ticket", *key)
    by_ticket = _cut(roles(tied, assignees, pulls, reviewers, branches, commits, me).join(of, "ticket"))
    # A pull request may tie to tickets of several projects and is in each; one without a ticket is in a project by repository.
    alone = loose(tied, pulls, reviewers, card_pulls, closeness, me, now, days)
    in_pull = tied.select("ticket", F.col("ref").alias("url")).join(of, "ticket").select("url", *key).distinct().unionByName(alone)
    in_pull = _cut(in_pull.join(pulls.select("url", F.col("state").alias("pr_state"), F.col("updated").alias("pr_at"), "author"), "url"))
    pr_only = in_pull.where("kind = 'pr'")
    read = pr_only.join(reviewers, "url").where(~F.col("person").eqNullSafe(F.col("author")))
    held = pr_only.join(card_pulls.select("url").distinct(), "url", "left_semi").withColumn("person", F.lit(me))
    on_pull = pr_only.select("url", *key, F.col("author").alias("person"), F.lit("author").alias("role"), "pr_at")
    for part, name in ((read, "reviewer"), (held, "context")):
        on_pull = on_pull.unionByName(part.select("url", *key, "person", F.lit(name).alias("role"), "pr_at"))
    on_pull = on_pull.where("person IS NOT NULL")
    members = by_ticket.select(*key, "person", "role").unionByName(on_pull.select(*key, "person", "role")).groupBy(*key, "person").agg(F.sort_array(F.collect_set("role")).alias("roles"))  # five roles at most
    members = members.join(closeness, "person", "left").fillna(0.0, ["closeness"])
    n = lambda c, *v: F.count_if(F.col(c).isin(*v))
    sums = rows.groupBy(*key).agg(F.count("*").alias("tickets"), *[n("state", s).alias(s) for s in ("done", "close", "progress", "todo")], F.max("updated").alias("at"))
    prs = in_pull.groupBy(*key).agg(F.count("*").alias("prs"), *[n("pr_state", s).alias(f"prs_{s}") for s in ("merged", "review", "draft", "open", "closed")], F.max("pr_at").alias("pr_at"))
    is_me = F.col("person") == me
    mine = by_ticket.where(is_me).groupBy(*key, "ticket").agg(F.max(_weight(F.col("role"))).alias("w")).groupBy(*key).agg(F.sum("w").alias("w"))
    mine_pr = on_pull.where(is_me).groupBy(*key).agg(F.max(_weight(F.col("role"))).alias("w_pr"))
    top = Window.partitionBy(*key).orderBy(F.desc("closeness"), "person")
    others = members.where(~is_me).withColumn("i", F.row_number().over(top))
    others = others.groupBy(*key).agg(F.count("*").alias("people"), F.round(F.avg(F.when(F.col("i") <= 3, F.col("closeness"))), 3).alias("closeness"))
    zero = ["tickets", "done", "close", "progress", "todo", "prs", "prs_merged", "prs_review", "prs_draft", "prs_open", "prs_closed", "people", "closeness"]
    out = sums.join(prs, key, "full").join(mine, key, "left").join(mine_pr, key, "left").join(others, key, "left").fillna(0, zero)
    seconds = lambda c: F.unix_micros(c) / 1e6
    part = F.coalesce(F.col("w") / (3.0 * F.col("tickets")), F.col("w_pr") / 3.0)  # null without the viewer; no role weighs over 3
    out = out.withColumns({"last": F.greatest("at", "pr_at"), "involvement": F.round(part, 3)})
    fresh = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), seconds(now) - seconds(F.col("last").cast("timestamp"))) / 86_400 / HALF_LIFE)
    all_closed = (F.col("prs_merged") > 0) & (F.col("prs_merged") + F.col("prs_closed") == F.col("prs")) & (F.col("progress") == 0) & (F.col("close") == 0)
    out = out.withColumns({
        "section": F.when(F.col("involvement").isNotNull(), "mine").otherwise("around"),
        "score": F.round(fresh * F.coalesce(0.4 + 0.6 * F.col("involvement"), 0.15 + F.col("closeness")), 5),
        "stale": F.col("last") < now - F.expr(f"INTERVAL {stale_days} DAYS"),
        "likely_done": (F.col("kind") != "pr") & (((F.col("tickets") > 0) & (F.col("done") == F.col("tickets"))) | all_closed),
    })
    return Projects(tied, rows, members, out.drop("at", "pr_at", "w", "w_pr"))
