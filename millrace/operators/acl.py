"""Security trimming: which users may see which rows.

A row has sensitivity_level, acl_users, acl_roles, acl_groups; a user user_id, roles, groups,
clearance, is_admin. The predicates trim hits; no filter passes a rank, so what a user may see
must be known before the top-k. For that, rows with the same rights form a class: principals
are joined with the classes that name them, and a retriever keeps a query to its classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = "cast(array() as array<string>)"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr(_EMPTY))


def level(c: Column) -> Column:
    """public stays public; all else, null included, is restricted."""
    return F.when(F.lower(F.coalesce(c, F.lit("internal"))) == "public", "public").otherwise("restricted")


def named() -> Column:
    """The row's lists name the user, a role or a group of theirs."""
    return F.array_contains(_list("acl_users"), F.col("user_id")) | F.arrays_overlap(_list("acl_roles"), _list("roles")) | F.arrays_overlap(_list("acl_groups"), _list("groups"))


def allowed() -> Column:
    """Admins see all, everyone what is public; a restricted row needs clearance and a list
    that names the user."""
    named_ = F.coalesce(named(), F.lit(False))
    return F.coalesce(F.col("is_admin"), F.lit(False)) | (level(F.col("sensitivity_level")) == "public") | ((F.lower(F.coalesce("clearance", F.lit("public"))) == "restricted") & named_)


def pushdown() -> Column:
    """The weaker form that a vector store can filter by: public, or named."""
    return (level(F.col("sensitivity_level")) == "public") | F.coalesce(named(), F.lit(False))


_RIGHTS = ("sensitivity_level", "acl_users", "acl_roles", "acl_groups")


def with_class(rows: DataFrame) -> DataFrame:
    """Rows with acl_class: the same for rows with the same level and lists, in any order."""
    lists = (F.array_sort(F.array_distinct(_list(c))) for c in _RIGHTS[1:])
    public = level(F.col("sensitivity_level")) == "public"
    return rows.withColumn("acl_class", F.when(public, F.lit(0).cast("long")).otherwise(F.xxhash64(F.to_json(F.struct(*lists)))))


def visible(rows: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, acl_class) of all classes of ``rows`` (of :func:`with_class`) that each user may see.

    A class is posted under every principal that it names, and users look theirs up: public rows
    under one that all have, restricted ones under names that only the cleared use. Admins are
    given every class. Only classes and users meet, never rows and users."""
    classes = rows.select("acl_class", *_RIGHTS).groupBy("acl_class").agg(*(F.first(c).alias(c) for c in _RIGHTS))
    principals = lambda prefix, c: F.transform(_list(c), lambda x: F.concat(F.lit(prefix), x))
    public = level(F.col("sensitivity_level")) == "public"
    posted = F.when(public, F.array(F.lit("*"))).otherwise(F.concat(*(principals(p, c) for p, c in zip(("u:", "r:", "g:"), _RIGHTS[1:], strict=True))))
    postings = classes.select("acl_class", F.explode(F.array_distinct(posted)).alias("principal"))
    cleared = F.lower(F.coalesce("clearance", F.lit("public"))) == "restricted"
    own = F.filter(F.concat(F.array(F.concat(F.lit("u:"), "user_id")), principals("r:", "roles"), principals("g:", "groups")), lambda x: x.isNotNull())
    held = users.select("user_id", F.explode(F.array_distinct(F.concat(F.array(F.lit("*")), F.when(cleared, own).otherwise(F.expr(_EMPTY))))).alias("principal"))
    admins = users.where(F.coalesce("is_admin", F.lit(False))).select("user_id", F.lit(1).alias("_all"))
    every = admins.join(classes.select("acl_class", F.lit(1).alias("_all")), "_all").select("user_id", "acl_class")
    return held.join(postings, "principal").select("user_id", "acl_class").unionByName(every).distinct()


def trim(hits: DataFrame, users: DataFrame) -> DataFrame:
    """Hits (with ACL columns and user_id) that their user may see; users are joined by id."""
    return hits.join(users, "user_id").where(allowed())


def blocked(hits: DataFrame, users: DataFrame) -> DataFrame:
    """(query_id, acl_blocked): whether a query had hits and none is left."""
    seen = hits.join(users, "user_id").select("query_id", allowed().alias("ok"))
    return seen.groupBy("query_id").agg((~F.bool_or("ok")).alias("acl_blocked"))
