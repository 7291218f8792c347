"""Helpers shared by all operators: table access, key comparison, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Session settings that suit the plans built here. The JVM leaves methods of more than 8000 bytes uncompiled; Spark splits
#: them only if told so, and wide rows of statistics grow beyond that.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name (one Parquet file or folder per table)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_form(c: Column) -> Column:
    """Keys as compared: surrounding blanks and tabs removed, letters in upper case."""
    return F.upper(F.btrim(c, F.lit(" \t")))


def real_key(c: Column) -> Column:
    """key_form, but NULL where the key is empty or only blanks (no reference)."""
    k = key_form(c)
    return F.when(k != "", k)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local session that has none gets one of its own, removed at its end."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quernel-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """df materialised in the shared folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(wanted: str, *frames: DataFrame) -> str:
    """A column name that clashes with none of the frames' (case-insensitive) names."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def join_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, NULL being equal to NULL; right's keys are dropped."""
    renamed = right.select(*[F.col(f"`{c}`").alias("_right_" + c if c in keys else c) for c in right.columns])
    same = None
    for k in keys:
        eq = F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`"))
        same = eq if same is None else same & eq
    return left.join(renamed, same, how).drop(*["_right_" + k for k in keys])


#: Columns whose cells are looked up in one array: what a wide row costs is its columns times at most so many comparisons of numbers.
BESIDE = 256


def side_by_side(cells: DataFrame, keys: list[str], head: str, value: str, heads: list[str], *more: Column) -> DataFrame:
    """One row per keys with a column _h0, _h1, ... per head, holding the value of its cell, and the aggregates `more`.

    cells: one row per keys and head; a NULL value is no cell. heads are few enough to be columns, so
    the table of their places is small.
    """
    places = cells.sparkSession.createDataFrame(list(zip(heads, range(len(heads)))), "_head string, _place int")
    placed = cells.join(F.broadcast(places), F.col(head) == F.col("_head"), "left")
    blocks = range(-(-len(heads) // BESIDE))
    made = []
    for b in blocks:
        here = (F.floor(F.col("_place") / BESIDE) == b) & F.col(value).isNotNull()
        # Both lists of a row are filled together, in the same order.
        made += [F.collect_list(F.when(here, F.col("_place"))).alias(f"_p{b}"), F.collect_list(F.when(here, F.col(value))).alias(f"_v{b}")]
    wide = placed.groupBy(*keys).agg(*made, *more)
    kept = [c for c in wide.columns if c[:2] not in ("_p", "_v") or not c[2:].isdigit()]
    found = [F.get(F.col(f"_v{i // BESIDE}"), (F.array_position(F.col(f"_p{i // BESIDE}"), i) - 1).cast("int")).alias(f"_h{i}") for i in range(len(heads))]
    return wide.select(*kept, *found)
