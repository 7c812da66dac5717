"""Nested answers of stored profiles of every version."""

from pyspark.sql import functions as F

from noticeloom.operators.rosters import rosters
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table

MEMBERS = '"householdMembers":[{"id":"m1","relation":"sibling","register":"applicant","dateOfBirth":"1990-01-01","ownsHome":true,"odd":{"x":[1]}},"junk",{"relation":"alien","register":7,"ownsHome":"yes","previouslyOwnedHome":false}]'
HOMES = '"ownershipFacts":[{"id":"h1","ownerMemberId":"m1","ownerRelation":"spouse","propertyKind":"apartment","officialValueKrw":"%s000","ownedShare":true,"note":{"deep":1}},null,{"ownerMemberId":"m9","ownerRelation":"cousin","propertyKind":"castle","officialValueKrw":"12x","areaSqm":84.5,"inMyeon":0}]'


@query("""WITH p AS (SELECT c_custkey AS profile_id, c_custkey % 6 AS v FROM customer)
SELECT profile_id, CASE WHEN v > 3 THEN 'm1:sibling:applicant:1990-01-01:true:|family-2:unknown:unknown:::false' ELSE '' END AS members,
  CASE WHEN v > 2 THEN 'h1:' || CASE WHEN v = 3 THEN 'spouse' ELSE 'm1' END || ':spouse:apartment:' || profile_id || '000:true:|property-2:' || CASE WHEN v = 3 THEN '' ELSE 'm9' END || ':unknown:unknown::::' ELSE '' END AS homes FROM p""".replace("::::' ELSE", ":::' ELSE"))
def migrated_rosters(spark, d):
    """Two members and two homes of profiles of versions 1 to 5, with junk between and inside them; a sixth of the bodies is no JSON."""
    v, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    left, right = HOMES.split("%s")
    body = F.concat(F.lit('{"version":'), v.cast("string"), F.lit(f',{MEMBERS},{left}'), key, F.lit(right + "}"))
    rows = rosters(table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.when(v > 0, body).otherwise("{").alias("body")))
    said = lambda *xs: F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("")) for x in xs])
    members = F.transform("members", lambda m: said(*[m[x] for x in ("id", "relation", "register", "dateOfBirth", "ownsHome", "previouslyOwnedHome")]))
    homes = F.transform("homes", lambda h: said(*[h[x] for x in ("id", "ownerMemberId", "ownerRelation", "propertyKind", "officialValueKrw", "ownedShare", "areaSqm")]))
    return rows.select("profile_id", F.array_join(members, "|").alias("members"), F.array_join(homes, "|").alias("homes"))
