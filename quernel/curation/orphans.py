"""References that point to no record valid at their time (problem 5).

Method: skew-aware split. The referenced table is folded to one row per key. References are
pre-aggregated per key and period (how many, first and last time), so that what is joined has no more
rows of a key than there are periods. Keys that hold a large share of all references are checked
against a broadcast of their folded rows, of which there are 1 / share at most; all others by a shuffle
join; both results are united. In a group all references are orphans, none is, or the boundary (first
load, last deletion) lies between its first and its last: only the last kind is counted row by row.
Lists of rows come by looking up the groups with orphans, split in the same way.

Edge cases: NULL or blank references are no references and never reported. A parent row with
a NULL loaded_at was always there; one with a NULL deleted_at is not deleted. A reference with
a NULL loaded_at can only be `missing`. An empty parent table makes every reference missing.
Other columns of either table are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.runtime import cut, real_key

#: A key is heavy from this share of all references on; so there are at most 1 / share of them.
HEAVY_SHARE = 1 / 500


def fold_parent(parent: DataFrame, key: str, loaded: str, deleted: str | None) -> DataFrame:
    """One row per key: when it first was there, whether a row is alive, when the last was deleted."""
    gone = F.col(deleted) if deleted else F.lit(None).cast("timestamp_ntz")
    return (
        parent.select(real_key(F.col(key)).alias("_key"), F.col(loaded).alias("_l"), gone.alias("_d"))
        .filter(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(
            F.min("_l").alias("_first"),
            F.max(F.col("_l").isNull()).alias("_always"),
            F.max(F.col("_d").isNull()).alias("_alive"),
            F.max("_d").alias("_last_deleted"),
        )
    )


def references(child: DataFrame, key: str, loaded: str, *keep: str) -> DataFrame:
    """The rows of child that refer to something, with their month as the period ("" without a time)."""
    at = F.col(f"`{loaded}`")
    return child.select(
        real_key(F.col(f"`{key}`")).alias("_key"), at.alias("_at"), F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("")).alias("_period"), *[F.col(f"`{k}`") for k in keep]
    ).filter(F.col("_key").isNotNull())


def fold_references(refs: DataFrame) -> DataFrame:
    """One row per key and period: how many references, the first and the last time. Written once, as heavy keys and both halves read it."""
    return cut(refs.groupBy("_key", "_period").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"), F.max("_at").alias("_to")))


def heavy_keys(groups: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(_key) of the keys that hold `share` of all references or more: no more than 1 / share rows."""
    per_key = groups.groupBy("_key").agg(F.sum("_n").alias("_n"))
    total = groups.agg(F.sum("_n").alias("_all"))
    return per_key.crossJoin(F.broadcast(total)).filter(F.col("_n") >= share * F.col("_all")).select("_key")  # one row beside it


def _split(left: DataFrame, heavy: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left joined with right: rows of heavy keys with a broadcast of what right has of them, all others by a shuffle."""
    few = F.broadcast(heavy)
    hot = left.join(few, "_key", "left_semi").join(F.broadcast(right.join(few, "_key", "left_semi")), keys, how)
    return left.join(few, "_key", "left_anti").join(right, keys, how).unionByName(hot)


def _late(at: Column) -> Column:
    return F.coalesce(~F.col("_always") & (F.col("_first") > at), F.lit(False))


def _deleted(at: Column) -> Column:
    return F.coalesce(~F.col("_alive") & (F.col("_last_deleted") <= at), F.lit(False))


def orphan_groups(groups: DataFrame, parent: DataFrame, heavy: DataFrame) -> DataFrame:
    """The groups with an orphan, with what the parent table has of the key, and whether all or some are of a reason."""
    joined = _split(groups, heavy, parent, ["_key"], "left")
    missing = F.col("_alive").isNull()
    some = joined.withColumns({
        "_missing": missing, "_all_late": ~missing & _late(F.col("_to")), "_some_late": ~missing & _late(F.col("_from")),
        "_all_deleted": ~missing & _deleted(F.col("_from")), "_some_deleted": ~missing & _deleted(F.col("_to")),
    })
    return some.filter("_missing or _some_late or _some_deleted")


def _reasons(at: Column) -> Column:
    """The reasons of a single reference beside its group."""
    return F.array_compact(F.array(
        F.when(F.col("_missing"), F.lit("missing")), F.when(~F.col("_missing") & _late(at), F.lit("late")), F.when(~F.col("_missing") & _deleted(at), F.lit("deleted"))
    ))


def orphan_rows(child: DataFrame, key: str, loaded: str, parent: DataFrame, row_id: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(row_id, reason) of every orphan reference; a row with two reasons comes twice."""
    refs = references(child, key, loaded, row_id)
    groups = fold_references(refs)
    heavy = heavy_keys(groups, share)
    found = orphan_groups(groups, parent, heavy).drop("_n", "_from", "_to")
    return _split(refs, heavy, found, ["_key", "_period"], "inner").select(row_id, F.explode(_reasons(F.col("_at"))).alias("reason"))


def orphan_counts(child: DataFrame, key: str, loaded: str, parent: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(month, reason, n)."""
    refs = references(child, key, loaded)
    groups = fold_references(refs)
    heavy = heavy_keys(groups, share)
    found = orphan_groups(groups, parent, heavy)
    mixed = (F.col("_some_late") & ~F.col("_all_late")) | (F.col("_some_deleted") & ~F.col("_all_deleted"))
    # A group with a reference without time is one of its own, so all of it have a time or none has.
    whole = found.filter(~mixed).select("_period", "_n", F.explode(F.array_compact(F.array(
        F.when(F.col("_missing"), F.lit("missing")), F.when(F.col("_all_late"), F.lit("late")), F.when(F.col("_all_deleted"), F.lit("deleted"))
    ))).alias("reason"))
    rest = _split(refs, heavy, found.filter(mixed).drop("_n", "_from", "_to"), ["_key", "_period"], "inner")
    rest = rest.select("_period", F.lit(1).cast("long").alias("_n"), F.explode(_reasons(F.col("_at"))).alias("reason"))
    both = whole.unionByName(rest).groupBy("_period", "reason").agg(F.sum("_n").alias("n"))
    return both.select(F.when(F.col("_period") != "", F.col("_period")).alias("month"), "reason", "n")
