"""Constrained identity resolution: keys of people are joined best-first unless the two sides can't be one person.

The order of the joins is that of a list of edges gone through one by one. Here many are decided at once: the edge that is first
for both its sides meets them just as it would in the list, as no edge before it touches either. So each round merges all such
pairs. Sides that can't be one stay so whatever else joins them (a mail address or account is on one side only), so edges between
them leave early. A round groups and joins on sides.

A name that many have is first for one of its edges only, so it takes a round for each. But edges that aren't connected never meet:
each connected part of up to SMALL edges is gone through in the list's order by one task, and rounds are left for larger ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators.linkage import group
from loomfield.operators.rounds import written

JOIN, MAYBE = 0.8, 0.55
#: Connected edges that one task goes through; a hundred bytes or so each.
SMALL = 500_000
#: Fixed texts: why two sides can't be one, the first that holds.
WHY = ("you split one of these identities", "two different chat accounts", "two different work mails with commits at one domain")


@dataclass
class Resolved:
    """people (key, person), joins (a, b, kind, score), rejected (a, b, score, why), maybe (a, b, score)."""

    people: DataFrame
    joins: DataFrame
    rejected: DataFrame
    maybe: DataFrame


def conflict(x: str, y: str) -> Column:
    """Why two sides (structs split, accounts, domains) can't be one person; null if they can."""
    return (
        F.when(F.col(f"{x}.split") | F.col(f"{y}.split"), WHY[0])
        .when(F.col(f"{x}.account") & F.col(f"{y}.account"), WHY[1])
        .when(F.arrays_overlap(f"{x}.domains", f"{y}.domains"), WHY[2])
    )


def traits(keys: DataFrame, work: DataFrame, split: DataFrame) -> DataFrame:
    """(side, t) of keys (key, side): whether one was split off, is a chat account, and the domains of work mails with commits."""
    known = keys.join(work.select("key", F.lit(True).alias("worked")).distinct(), "key", "left").join(split.select("key", F.lit(True).alias("cut_off")).distinct(), "key", "left")
    off = F.coalesce("cut_off", F.lit(False))
    mail = F.substring_index("key", "email:", -1)
    domain = F.when(F.col("key").startswith("email:") & F.col("worked") & ~off & (tx.mail_class(mail) == "work"), F.lower(F.substring_index(mail, "@", -1)))
    fields = F.struct(
        F.max(off).alias("split"), F.max(F.col("key").startswith("slack:") & ~off).alias("account"), F.collect_set(domain).alias("domains")
    )
    return known.groupBy("side").agg(fields.alias("t"))


def _one_by_one(frame: pd.DataFrame) -> pd.DataFrame:
    """(part, nth, why) of the edges of one connected part that merge (no why) or are refused, in their order."""
    root: dict[str, str] = {}
    facts: dict[str, tuple[bool, bool, set[str]]] = {}

    def find(k: str) -> str:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for e in frame.sort_values("nth").itertuples(index=False):
        for k, split, account, domains in ((e.a, e.x_split, e.x_account, e.x_domains), (e.b, e.y_split, e.y_account, e.y_domains)):
            if k not in root:
                root[k], facts[k] = k, (bool(split), bool(account), set(domains))
        a, b = sorted((find(e.a), find(e.b)))
        if a == b:
            continue
        x, y = facts[a], facts[b]
        why = WHY[0] if x[0] or y[0] else WHY[1] if x[1] and y[1] else WHY[2] if not x[2].isdisjoint(y[2]) else None
        if why is None:
            root[b] = a
            less, more = sorted((x[2], y[2]), key=len)
            more |= less
            facts[a] = (False, x[1] or y[1], more)
            del facts[b]
        out.append((e.part, e.nth, why))
    return pd.DataFrame(out, columns=["part", "nth", "why"])


def merge_edges(edges: DataFrame, sides: DataFrame, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """As `merge_best_first`, but connected parts of up to `small` edges are settled by a task each; merged edges have the first names."""
    part = group(edges.select("a", "b")).select(F.col("node").alias("a"), F.col("component").alias("part"))
    parted = written(edges.select("a", "b", "turn").join(part, "a"))
    large = written(parted.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > (SMALL if small is None else small)))
    order = Window.partitionBy("part").orderBy("turn")
    rest = written(parted.join(F.broadcast(large), "part", "left_anti").withColumn("nth", F.row_number().over(order)))
    for c, t in (("a", "x"), ("b", "y")):
        fields = [F.coalesce(f"t.{f}", F.lit(False)).alias(f"{t}_{f}") for f in ("split", "account")]
        rest_with = (rest if t == "x" else rest_with).join(sides.select(F.col("side").alias(c), *fields, F.col("t.domains").alias(f"{t}_domains")), c)
    kind = edges.schema["a"].dataType.simpleString()
    settled = written(rest_with.drop("turn").groupBy("part").applyInPandas(_one_by_one, f"part {kind}, nth int, why string"))
    done = rest.join(settled, ["part", "nth"])
    merged, refused = done.where("why IS NULL").select("a", "b", "turn"), done.where("why IS NOT NULL").select("turn", "why")
    if large.isEmpty():
        return merged, refused
    more, no = merge_best_first(parted.join(large, "part", "left_semi").drop("part"), sides)
    return merged.unionByName(more), refused.unionByName(no)


def merge_best_first(edges: DataFrame, sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged and refused edges of (a, b, turn, ...) between sides (side, t), in the order of `turn`, which must be unique.

    Merged: (a, b, turn) as the sides then were named; refused: (turn, why). A side is named by its least member.
    """
    merged, refused = [], []
    while True:
        x, y = sides.select(F.col("side").alias("a"), F.col("t").alias("x")), sides.select(F.col("side").alias("b"), F.col("t").alias("y"))
        judged = written(edges.select("a", "b", "turn").join(x, "a").join(y, "b").select("a", "b", "turn", conflict("x", "y").alias("why")))
        refused.append(judged.where("why IS NOT NULL").select("turn", "why"))
        live = judged.where("why IS NULL")
        first = live.select(F.explode(F.array("a", "b")).alias("side"), "turn").groupBy("side").agg(F.min("turn").alias("turn"))
        # An edge is met twice among the first ones if it is first for both its sides.
        both = first.groupBy("turn").agg(F.count("*").alias("n")).where("n = 2")
        now = written(live.join(both, "turn").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "turn"))
        if now.isEmpty():
            break
        merged.append(now)
        renamed = lambda c: now.select(F.col("b").alias(c), F.col("a").alias(f"{c}_new"))  # noqa: E731, B023
        moved = live.join(renamed("a"), "a", "left").join(renamed("b"), "b", "left")
        edges = moved.select(F.coalesce("a_new", "a").alias("a"), F.coalesce("b_new", "b").alias("b"), "turn").where("a <> b")
        joined = sides.join(renamed("side"), "side", "left").groupBy(F.coalesce("side_new", "side").alias("side"))
        fields = F.struct(F.max("t.split").alias("split"), F.max("t.account").alias("account"), F.flatten(F.collect_list("t.domains")).alias("domains"))
        sides = written(joined.agg(fields.alias("t")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(merged) if merged else edges.select("a", "b", "turn").limit(0), union(refused)


def resolve(observations: DataFrame, candidates: DataFrame, work: DataFrame, split: DataFrame, merge: DataFrame, me: DataFrame) -> Resolved:
    """People from observations (obs, keys) of keys as `kind:value`, kinds name, gh, email and slack.

    Keys that one observation lists together are one person, but for names and split keys. A name joins the observation's first
    other key, in the order of obs; then candidates (a, b, score) from JOIN on join, best first, ties by a and b; both unless
    `conflict`. Last, whatever they are: pairs of `merge` (a, b) and all keys of `me` (key) that aren't split. `work` (key) has
    keys with commits. A person is named by the least key. Candidates from MAYBE on that don't join are given as maybe. Null
    keys, keys that no observation has and repeated rows don't count; empty tables give empty results.
    """
    off = split.select("key").distinct()
    seen = observations.select("obs", F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL")
    seen = written(seen.join(off.withColumn("off", F.lit(True)), "key", "left").select("obs", "at", "key", F.coalesce("off", F.lit(False)).alias("off")))
    named = F.col("key").startswith("name:")
    first = seen.where(~named & ~F.col("off")).groupBy("obs").agg(F.min_by("key", "at").alias("first"))
    facts = seen.where(~named & ~F.col("off")).join(first, "obs").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    keys = seen.select("key").distinct()
    side = written(keys.join(group(facts).select(F.col("node").alias("key"), "component"), "key", "left").select("key", F.coalesce("component", "key").alias("side")))

    padded = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    turn = F.struct(F.lit(0).alias("phase"), F.lit(0.0).alias("low"), padded("obs", 20).alias("m"), padded("at", 9).alias("n"))
    by_name = seen.where(named & ~F.col("off")).join(first, "obs").select(F.col("first").alias("p"), F.col("key").alias("q"), turn.alias("turn"), F.lit(0.9).alias("score"))
    pairs = candidates.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.max("score").alias("score"))
    turn = F.struct(F.lit(1).alias("phase"), (-F.col("score")).alias("low"), F.col("p").alias("m"), F.col("q").alias("n"))
    likely = pairs.where(F.col("score") >= JOIN).select("p", "q", turn.alias("turn"), "score")
    listed = written(by_name.unionByName(likely))
    of = lambda rows, c, name: rows.join(side.select(F.col("key").alias(c), F.col("side").alias(name)), c)
    edges = of(of(listed, "p", "a"), "q", "b").where("a <> b")
    merged, refused = merge_edges(edges, written(traits(side, work, split)))

    forced = merge.select("a", "b", F.lit("user").alias("kind"))
    mine = me.select("key").distinct().join(keys, "key").join(off, "key", "left_anti")
    forced = forced.unionByName(mine.crossJoin(F.broadcast(mine.agg(F.min("key").alias("a")))).where("key <> a").select("a", F.col("key").alias("b"), F.lit("me").alias("kind")))
    forced = forced.join(keys.withColumnRenamed("key", "a"), "a").join(keys.withColumnRenamed("key", "b"), "b")
    on_sides = of(of(forced.select(F.col("a").alias("p"), F.col("b").alias("q")), "p", "a"), "q", "b").where("a <> b").select("a", "b")
    last = group(merged.select("a", "b").unionByName(on_sides))
    people = side.join(last.select(F.col("node").alias("side"), "component"), "side", "left").select("key", F.coalesce("component", "side").alias("root"))
    person = people.groupBy("root").agg(F.min("key").alias("person"))
    people = written(people.join(person, "root").select("key", "person"))

    joins = listed.join(merged.select("turn"), "turn").select(F.col("p").alias("a"), F.col("q").alias("b"), F.lit("evidence").alias("kind"), "score")
    joins = joins.unionByName(forced.select("a", "b", "kind", F.lit(1.0).alias("score")))
    rejected = listed.join(refused, "turn").select(F.col("p").alias("a"), F.col("q").alias("b"), "score", "why")
    open_ = pairs.where(F.col("score").between(MAYBE, JOIN) & (F.col("score") < JOIN))
    sides = traits(people.select("key", F.col("person").alias("side")), work, split)
    whose = lambda rows, c, name: rows.join(people.select(F.col("key").alias(c), F.col("person").alias(name)), c).join(sides.select(F.col("side").alias(name), F.col("t").alias(f"{name}_t")), name)
    maybe = whose(whose(open_, "p", "x"), "q", "y").where("x <> y").where(conflict("x_t", "y_t").isNull()).select(F.col("p").alias("a"), F.col("q").alias("b"), "score")
    return Resolved(people, joins, rejected, maybe)
