"""Entity resolution: keys, matches, clusters, companies and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions import names as N
from lintel.functions.similarity import token_set_ratio
from lintel.plans.components import connected_components
from lintel.plans.similar import FLOOR, similar_pairs
from lintel.plans.skew import salted_lookup
from lintel.session import stored

# Score bands of the merge decision.
MERGE_SCORE = 92.0
REVIEW_SCORE = FLOOR


def normalize_members(members: DataFrame) -> DataFrame:
    """Add the comparison keys; raw values stay."""
    return members.withColumns({
        "normalized_key": N.normalize_company(F.col("raw_name")),
        "phone_key": N.phone_key(F.col("phone")),
        "email_key": N.email_key(F.col("email")),
        "address_key": N.address_key(F.col("address")),
        "zip5": N.zip5(F.col("address")),
        "license_key": N.license_key(F.col("license_number")),
    })


def star_edges(members: DataFrame, keys: Sequence[str], basis: str) -> DataFrame:
    """Link members with equal, non-null keys to the lowest member of their group.

    One edge per member says all that all pairs would, and a group of any size
    stays linear.
    """
    keys = list(keys)
    keyed = members.dropna(subset=keys).select("member_id", *keys).distinct()
    groups = keyed.groupBy(*keys).agg(F.min("member_id").alias("left_id"), F.count(F.lit(1)).alias("_rows"))
    linked = salted_lookup(keyed, groups.filter("_rows > 1").drop("_rows"), keys, "inner",
                           counted_on=members)
    return (linked.filter("member_id <> left_id")
            .select("left_id", F.col("member_id").alias("right_id"), F.lit(basis).alias("basis")))


def match_license(members: DataFrame) -> DataFrame:
    """Same licence type and number; numbers of different boards never meet."""
    return star_edges(members, ["license_type", "license_key"], "license")


def match_name(members: DataFrame) -> DataFrame:
    return star_edges(members, ["normalized_key"], "name")


def name_contacts(members: DataFrame) -> DataFrame:
    """Distinct (name, kind, contact) with both sides known."""
    sides = F.explode(F.array(
        F.struct(F.lit("phone").alias("kind"), F.col("phone_key").alias("contact")),
        F.struct(F.lit("address").alias("kind"), F.col("address_key").alias("contact"))))
    return (members.select(F.col("normalized_key").alias("name"), sides.alias("s"))
            .select("name", "s.kind", "s.contact").dropna().distinct())


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Every pair of distinct names that shares a phone or an address and reaches the review score, with its score."""
    return similar_pairs(name_contacts(members))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Scores of pairs that the caller brings."""
    return pairs.withColumn("score", token_set_ratio("left_key", "right_key"))


def resolve_pairs(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split scored pairs into merges and the review queue.

    At or above the merge score a shared phone or address is needed; anything
    from the review score up that may not merge goes to a person.  Pairs from
    ``candidate_pairs`` always share one; pairs brought by the caller may not.
    """
    backed = F.coalesce(F.col("shared_phone") | F.col("shared_address"), F.lit(False))
    decision = (F.when((F.col("score") >= MERGE_SCORE) & backed, F.lit("merge"))
                .when(F.col("score") >= REVIEW_SCORE, F.lit("review")))
    decided = scored.withColumn("decision", decision)
    queue = decided.filter(F.col("decision") == "review").withColumn(
        "reason", F.when(F.col("score") >= MERGE_SCORE, F.lit("similar, no shared contact"))
        .otherwise(F.lit("similar, below merge score")))
    return decided.filter(F.col("decision") == "merge"), queue


def merge_edges(members: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged names as edges between the lowest member of each name."""
    first = (members.dropna(subset=["normalized_key"]).groupBy("normalized_key")
             .agg(F.min("member_id").alias("first_id")))
    left = first.select(F.col("normalized_key").alias("left_key"), F.col("first_id").alias("left_id"))
    right = first.select(F.col("normalized_key").alias("right_key"), F.col("first_id").alias("right_id"))
    found = salted_lookup(merges.select("left_key", "right_key"), left, ["left_key"], "inner")
    found = salted_lookup(found, right, ["right_key"], "inner", counted_on=merges)
    return found.select("left_id", "right_id", F.lit("similar").alias("basis"))


def cluster(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``(member_id, company_id)`` for every member; company id is the lowest member."""
    found = connected_components(edges).select(F.col("node").alias("member_id"),
                                               F.col("component").alias("company_id"))
    return (members.select("member_id").distinct().join(found, "member_id", "left")
            .withColumn("company_id", F.coalesce("company_id", "member_id")))


def resolve_members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with keys and company id, and the review queue."""
    keyed = stored(normalize_members(members), "keyed")
    merges, queue = resolve_pairs(candidate_pairs(keyed))
    edges = match_license(keyed).unionByName(match_name(keyed)).unionByName(merge_edges(keyed, merges))
    return keyed.join(cluster(keyed, edges), "member_id"), queue


def company_values(clustered: DataFrame) -> DataFrame:
    """Child rows: every distinct alias and licence of every company, with how often it occurs."""
    kinds = F.explode(F.array(
        F.struct(F.lit("alias").alias("kind"), F.col("raw_name").alias("value")),
        F.struct(F.lit("license").alias("kind"), F.col("license_key").alias("value")),
        F.struct(F.lit("phone").alias("kind"), F.col("phone_key").alias("value")),
        F.struct(F.lit("address").alias("kind"), F.col("address_key").alias("value")),
        F.struct(F.lit("name_key").alias("kind"), F.col("normalized_key").alias("value"))))
    return (clustered.select("company_id", kinds.alias("k"))
            .select("company_id", "k.kind", "k.value").dropna()
            .groupBy("company_id", "kind", "value").agg(F.count(F.lit(1)).alias("seen")))


def build_company(clustered: DataFrame) -> DataFrame:
    """One row per company: most frequent name and contact, and how many names and licences it has.

    The names and licences themselves are rows of ``company_values``, however many there are.
    """
    values = company_values(clustered)

    def top(kind):
        best = F.min(F.when(F.col("kind") == kind, F.struct((-F.col("seen")).alias("n"), "value")))
        return best["value"]

    def many(kind):
        return F.count(F.when(F.col("kind") == kind, 1))

    return values.groupBy("company_id").agg(
        top("alias").alias("canonical_name"), top("name_key").alias("normalized_key"),
        top("phone").alias("phone"), top("address").alias("address"),
        many("alias").alias("n_aliases"), many("license").alias("n_licenses"))


def _links(rows: DataFrame, by_license: DataFrame, keys: Sequence[str], clustered: DataFrame) -> DataFrame:
    """Fill a missing company by licence, then by normalised name."""
    by_name = (clustered.dropna(subset=["normalized_key"]).groupBy("normalized_key")
               .agg(F.min("company_id").alias("_by_name")))
    keyed = rows.withColumns({"license_key": N.license_key(F.col("license_number")),
                              "normalized_key": N.normalize_company(F.col("raw_name"))})
    found = salted_lookup(keyed, by_license, list(keys), "left")
    found = salted_lookup(found, by_name, ["normalized_key"], "left", counted_on=keyed)
    known = [F.col("company_id")] if "company_id" in rows.columns else []
    return (found.withColumn("link_basis", F.when(F.col("_by_license").isNotNull(), F.lit("license"))
                             .when(F.col("_by_name").isNotNull(), F.lit("name")))
            .withColumn("company_id", F.coalesce(*known, F.col("_by_license"), F.col("_by_name")))
            .drop("_by_license", "_by_name", "license_key", "normalized_key"))


def link_parties(parties: DataFrame, clustered: DataFrame) -> DataFrame:
    """Party to company by licence number, then by normalised name.

    A party does not say which board its number is from, so a number links only if one company
    alone holds it.
    """
    by_license = (clustered.dropna(subset=["license_key"]).groupBy("license_key")
                  .agg(F.min("company_id").alias("_by_license"), F.max("company_id").alias("_other"))
                  .filter("_by_license = _other").drop("_other"))
    return _links(parties, by_license, ["license_key"], clustered)


def link_person(people: DataFrame, clustered: DataFrame) -> DataFrame:
    """Engineer to firm by licence type and number, then by the firm name on the licence."""
    by_license = (clustered.dropna(subset=["license_type", "license_key"]).groupBy("license_type", "license_key")
                  .agg(F.min("company_id").alias("_by_license")))
    return _links(people, by_license, ["license_type", "license_key"], clustered)


def review_queue_append(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Keep the queue, add pairs it has never held; decided pairs stay decided."""
    pair = ["left_key", "right_key"]
    fresh = new.dropDuplicates(pair).join(queue.select(*pair).distinct(), pair, "left_anti")
    return queue.unionByName(fresh.select(*queue.columns))
