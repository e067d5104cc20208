"""Queries that join mentions with the people who speak and the groups these belong to.

The tables hold people, not their groups. Two kinds of organisations are derived from them: a country's parliament, of
which a person is a member since a day with an open end, and the group of a decade of birth, whose membership has an
open start and ends ten years after that day. Dates are text, some of less than a day's precision, as in the corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plenarium.functions import text as T
from plenarium.operators import dyadic as D
from plenarium.sources.tables import table


def _people(spark, folder):
    return table(spark, folder, "people")


def _affiliations(spark, folder):
    p = _people(spark, folder).where("country is not null")
    since, none = F.date_format("member_since", "yyyy-MM-dd"), F.lit(None).cast("string")
    decade = F.concat("country", F.lit("-"), (F.floor(F.col("birth_year") / 10) * 10).cast("string"))
    kept = lambda org, role, start, end: p.select("speaker_id", "country", org.alias("org_id"), F.lit(role).alias("role"), start.alias("start_date"), end.alias("end_date"))
    parts = [
        kept(F.concat("country", F.lit("-P")), "member", since, none),
        kept(decade, "member", none, F.date_format(F.date_add("member_since", 3650), "yyyy-MM-dd")),
        kept(F.concat("country", F.lit("-P")), "observer", F.substring(since, 1, 7), none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("org_id is not null")


def _orgs(spark, folder):
    ids = _affiliations(spark, folder).select("org_id", "country").distinct()
    return ids.select("org_id", "country", F.concat(F.lit("Group "), "org_id").alias("org_name"), F.when(F.col("org_id").endswith("-P"), "parliament").otherwise("parliamentaryGroup").alias("org_role"))


def _mentions(spark, folder):
    """Mentions with the bare identifier of the person."""
    facts = table(spark, folder, "facts", "fact_id", "speaker_id", "country", "session_date")
    return facts.select("fact_id", "country", "session_date", F.upper(T.bare_id(F.col("speaker_id"))).alias("person"))


def _memberships(spark, folder, kind):
    return D.group_memberships(_affiliations(spark, folder), _orgs(spark, folder), org_role=kind).withColumn("person", F.upper(T.bare_id(F.col("speaker_id"))))


def d7_memberships(spark, folder):
    """Members of groups, with dates."""
    return D.group_memberships(_affiliations(spark, folder), _orgs(spark, folder)).select("speaker_id", "country", "party_group", "start_date", "end_date")


def d8_group_at_date(spark, folder):
    """Each mention with the group or parliament its speaker belonged to on that day."""
    held = _memberships(spark, folder, "parliamentaryGroup").unionByName(_memberships(spark, folder, "parliament"))
    return D.best_valid(_mentions(spark, folder), held, ["person", "country"], "session_date", "start_date", "end_date", ["party_group"]).select("fact_id", "party_group")


def d9_all_groups(spark, folder):
    """Mentions with every membership of their speaker that had begun and was not over, counted per organisation."""
    held = _memberships(spark, folder, "parliament").select("person", "country", "party_group", "start_date", "end_date")
    return D.all_valid(_mentions(spark, folder), held, ["person", "country"], "session_date", "start_date", "end_date").groupBy("party_group").agg(F.count(F.lit(1)).alias("n"))


def d10_members(spark, folder):
    """People whose membership began within some years, with their organisations."""
    return D.member_metadata(_people(spark, folder), _affiliations(spark, folder), _orgs(spark, folder), "2012", "2016").select("speaker_id", "country", "gender", "org_name", "role", "start_date")


QUERIES = {f.__name__: f for f in (d7_memberships, d8_group_at_date, d9_all_groups, d10_members)}

_BARE = "upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"
_AFF = f"""WITH p AS (SELECT *, strftime(member_since, '%Y-%m-%d') AS since FROM people WHERE country IS NOT NULL),
aff AS (SELECT * FROM (
  SELECT speaker_id, country, country || '-P' AS org_id, 'member' AS role, since AS start_date, NULL::varchar AS end_date FROM p
  UNION ALL SELECT speaker_id, country, country || '-' || cast(birth_year // 10 * 10 AS varchar), 'member', NULL, strftime(member_since + 3650, '%Y-%m-%d') FROM p
  UNION ALL SELECT speaker_id, country, country || '-P', 'observer', since[1:7], NULL FROM p) WHERE org_id IS NOT NULL),
orgs AS (SELECT DISTINCT org_id, 'Group ' || org_id AS org_name, CASE WHEN suffix(org_id, '-P') THEN 'parliament' ELSE 'parliamentaryGroup' END AS org_role FROM aff),
held AS (SELECT speaker_id, {_BARE.format("speaker_id")} AS person, country, org_role, org_name AS party_group, try_cast(start_date AS date) AS start_date, try_cast(end_date AS date) AS end_date FROM aff JOIN orgs USING (org_id) WHERE role = 'member'),
m AS (SELECT fact_id, country, session_date, {_BARE.format("speaker_id")} AS person FROM facts)"""
ORACLE = {
    "d7_memberships": _AFF + " SELECT speaker_id, country, party_group, start_date, end_date FROM held WHERE org_role = 'parliamentaryGroup'",
    "d8_group_at_date": _AFF + """, b AS (SELECT fact_id, party_group FROM m JOIN held USING (person, country) WHERE (start_date IS NULL OR start_date <= session_date) AND (end_date IS NULL OR session_date <= end_date)
        QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY start_date DESC NULLS FIRST, party_group) = 1) SELECT fact_id, party_group FROM m LEFT JOIN b USING (fact_id)""",
    "d9_all_groups": _AFF + " SELECT party_group, count(*) AS n FROM (SELECT DISTINCT m.*, party_group, start_date, end_date FROM m JOIN held USING (person, country) WHERE org_role = 'parliament' AND start_date <= session_date AND (end_date IS NULL OR session_date <= end_date)) GROUP BY 1",
    "d10_members": _AFF + " SELECT speaker_id, country, gender, org_name, role, start_date FROM people JOIN aff USING (speaker_id, country) JOIN orgs USING (org_id) WHERE start_date > '2012' AND start_date < '2016'",
}
