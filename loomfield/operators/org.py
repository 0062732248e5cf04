"""The organisation that people's work shows: teams with a name, everyone's team and role."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.operators.ownership import roles
from loomfield.operators.rounds import written
from loomfield.operators.teams import likeness, teams


@dataclass
class Org:
    """people (person, team, team_confidence, level, depth, breadth, confidence), teams (team, name, listed, size, members)."""

    people: DataFrame
    teams: DataFrame


def owned_areas(areas: DataFrame, least: int = 10, share: float = 0.4) -> DataFrame:
    """(person, owned_areas): areas (member, key, n) of two people or more in which one has `least` commits and `share` of all."""
    by_area = Window.partitionBy("key")
    rows = areas.withColumns({"total": F.sum("n").over(by_area), "people": F.count("*").over(by_area), "r": F.row_number().over(by_area.orderBy(F.desc("n"), "member"))})
    own = rows.where((F.col("r") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total")) & (F.col("people") >= 2))
    return own.groupBy(F.col("member").alias("person")).agg(F.count("*").alias("owned_areas"))


def top_approvers(approvals: DataFrame, least: float = 3.5, share: float = 0.5) -> DataFrame:
    """(author, approver): who gives `share` or more of an author's approvals (author, approver, n), of `least` or more."""
    by_author = Window.partitionBy("author")
    rows = approvals.where("author <> approver").groupBy("author", "approver").agg(F.sum("n").alias("n"))
    rows = rows.withColumns({"total": F.sum("n").over(by_author), "r": F.row_number().over(by_author.orderBy(F.desc("n"), "approver"))})
    return rows.where((F.col("r") == 1) & (F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).select("author", "approver")


def name_teams(of: DataFrame, areas: DataFrame, channels: DataFrame, groups: DataFrame) -> DataFrame:
    """(team, name, listed, size, members) of (member, team).

    A team has the name of the listed group that half of it or more, and two at least, are in (the most, then the smaller group,
    then the last by name); else of the area, else the channel, of two members or more that sets it apart: held by half of the
    team before others, then by the share of all who have it, then by members, then by name; else `Group`.
    """
    sizes = of.groupBy("team").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("member")).alias("members"))
    held = groups.select("member", "key").distinct()
    group_size = held.groupBy("key").agg(F.count("*").alias("all"))
    listed = of.join(held, "member").groupBy("team", "key").agg(F.count("*").alias("n")).join(group_size, "key").join(sizes, "team")
    listed = listed.where((F.col("n") >= 2) & (F.col("n") * 2 >= F.col("size"))).groupBy("team").agg(F.max(F.struct("n", (-F.col("all")).alias("less"), "key"))["key"].cast("string").alias("listed"))

    def apart(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select("member", "key").distinct()
        df = own.groupBy("key").agg(F.count("*").alias("df"))
        n = of.join(own, "member").groupBy("team", "key").agg(F.count("*").alias("n")).where("n >= 2").join(df, "key").join(sizes, "team")
        few = F.col("n") < F.greatest(F.lit(2.0), F.col("size") / 2)
        first = F.min(F.struct(few.alias("few"), (-F.col("n") / F.col("df")).alias("share"), (-F.col("n")).alias("more"), "key"))
        return n.groupBy("team").agg(first["key"].cast("string").alias(name))

    all_names = sizes.join(listed, "team", "left").join(apart(areas, "area"), "team", "left").join(apart(channels, "channel"), "team", "left")
    return all_names.select("team", F.coalesce("listed", "area", "channel", F.lit("Group")).alias("name"), "listed", "size", "members")


def infer(people: DataFrame, areas: DataFrame, channels: DataFrame, groups: DataFrame, approvals: DataFrame, facts: DataFrame, now: Column) -> Org:
    """Teams and roles of people (person, place).

    From areas (member, repo, key, n commits), channels (member, key, n messages), listed groups (member, key, maintains),
    approvals (author, approver, n) and facts (person, blame, owns, first, prs, reviews). A person in a team has the mean of its
    three nearest there as part of its confidence, and more for being in the listed group that the team is named for. Each person
    of `people` has one row; those without work have neither team nor level.
    """
    like = likeness(areas, channels, groups)
    of = written(teams(people.select(F.col("person").alias("member"), "place"), like))
    named = written(name_teams(of, areas, channels, groups))

    near = like.nearest(of.select("member", F.col("team").alias("grp")), 3)
    near = near.groupBy(F.col("a").alias("member")).agg(F.avg("sim").alias("near"))
    mine = of.join(named.select("team", "listed"), "team").join(groups.select("member", F.col("key").cast("string").alias("listed")).distinct().withColumn("is_in", F.lit(0.15)), ["member", "listed"], "left")
    sure = F.round(F.least(F.lit(0.9), 0.3 + F.coalesce("near", F.lit(0.0)) + F.coalesce("is_in", F.lit(0.0))), 2)
    placed = mine.join(near, "member", "left").select(F.col("member").alias("person"), "team", sure.alias("team_confidence"))

    often = areas.where("n >= 3").groupBy(F.col("member").alias("person")).agg(F.count_distinct("repo").alias("repos"), F.count_distinct("key").alias("areas"))
    most = areas.groupBy(F.col("member").alias("person")).agg(F.max("n").alias("top_commits"))
    approved = approvals.where("author <> approver AND n > 0").groupBy(F.col("approver").alias("person")).agg(F.count_distinct("author").alias("approved"))
    approver_for = top_approvers(approvals).groupBy(F.col("approver").alias("person")).agg(F.count("*").alias("approver_for"))
    maintains = groups.where("maintains").groupBy(F.col("member").alias("person")).agg(F.count_distinct("key").alias("maintains"))
    work = people.select("person")
    for part in (facts, owned_areas(areas), often, most, approved, approver_for, maintains):
        work = work.join(part, "person", "left")
    out = roles(work, now).join(placed, "person", "left")
    return Org(out.select("person", "team", F.coalesce("team_confidence", F.lit(0.0)).alias("team_confidence"), "level", "depth", "breadth", "confidence"), named)
