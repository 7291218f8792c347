"""Entity, attribute, value rows as one typed row per entity (problem 6).

Method: log-structured upserts. A batch becomes sparse wide deltas: one row per entity with the cells
it brings, each with its version (load time, row id) and what is needed to tell conflicts. Repeats
within the batch are folded before they are shuffled. Deltas are kept in a log, a Parquet table with
a run per load, hashed into buckets and sorted by entity; a new load adds a run and reads nothing
else. Runs are merged bucket by bucket without a shuffle, the latest readable version of a cell
winning; compact() replaces the runs by what they come to.

Edge cases: rows with a NULL or blank entity, attribute or entry count for nothing. An attribute
that the dictionary doesn't know is text in the report and gets no column. Of equal versions the
entry greater by bytes wins. Integers beyond 64 bits are readable, but NULL in the wide table.
An empty table gives an empty report and an empty wide table with all columns. A load that comes again
changes nothing but what it has anew. Values are compared by a 64-bit hash of their canonical form (two
different ones are taken as equal with a probability of 2^-64). The types of a log's attributes don't
change.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.runtime import checkpoint_dir, real_key, side_by_side

#: The entries that mean true and false.
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
DOUBLE = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
BIGINT = r"^[+-]?[0-9]+$"
#: The dictionary becomes columns, so it is small by nature; more than this is an error.
MAX_COLUMNS = 20_000
#: Rows that a task folds at a time.
FOLDED = 1 << 17
#: What a delta keeps of a cell.
CELL = ("attribute", "latest", "code", "differs", "readable")


def attribute_types(attributes: DataFrame, name: str, kind: str) -> dict[str, str]:
    """Attribute (in key form) to type; the first by type name where an attribute comes twice."""
    rows = (
        attributes.select(real_key(F.col(name)).alias("a"), F.lower(F.trim(F.col(kind))).alias("t"))
        .filter("a is not null").groupBy("a").agg(F.min("t").alias("t")).limit(MAX_COLUMNS + 1).collect()
    )
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} attributes cannot become columns")
    return {r.a: r.t if r.t in ("double", "bigint", "boolean") else "string" for r in sorted(rows)}


def _typed(text: Column, kind: Column) -> tuple[Column, Column]:
    """Whether an entry is readable, and a hash of its value in its type."""
    low = F.lower(text)
    is_true, is_false = low.isin(*TRUE), low.isin(*FALSE)
    ok = (
        F.when(kind == "double", text.rlike(DOUBLE))
        .when(kind == "bigint", text.rlike(BIGINT))
        .when(kind == "boolean", is_true | is_false)
        .otherwise(F.lit(True))
    )
    digits = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    digits = F.when(digits == "-0", F.lit("0")).otherwise(digits)
    code = (
        F.when(kind == "double", F.xxhash64(text.try_cast("double") + F.lit(0.0))).when(kind == "bigint", F.xxhash64(digits))
        .when(kind == "boolean", is_true.cast("long")).otherwise(F.xxhash64(text))
    )
    return ok, F.when(ok, code)


def deltas(rows: DataFrame, types: dict[str, str], entity: str, attribute: str, value: str, version: list[str], run: str) -> DataFrame:
    """One sparse cell per row: entity, attribute, version, entry and its reading."""
    by_kind = {k: [a for a, t in types.items() if t == k] for k in ("double", "bigint", "boolean")}
    base = rows.select(
        F.col(run).alias("run"), real_key(F.col(entity)).alias("entity"), real_key(F.col(attribute)).alias("attribute"),
        F.btrim(F.col(value), F.lit(" \t\n\r")).alias("entry"), F.struct(*[F.col(v) for v in version]).alias("version"),
    ).filter("entity is not null and attribute is not null and entry != ''")
    kind = F.lit("string")
    for k, names in by_kind.items():
        if names:
            kind = F.when(F.col("attribute").isin(names), F.lit(k)).otherwise(kind)
    base = base.withColumn("kind", kind)
    ok, code = _typed(F.col("entry"), F.col("kind"))
    return base.withColumns({"readable": ok, "code": code})


def _fold(cells: DataFrame, *keys: str) -> DataFrame:
    """One row per cell: the latest readable entry with its version, a hash of its value, whether others differ, and whether all are readable."""
    differ = F.coalesce(F.min("code") != F.max("code"), F.lit(False))
    return cells.groupBy(*keys, "entity", "attribute").agg(
        F.max("latest").alias("latest"), F.min("code").alias("code"), (differ | F.max("differs")).alias("differs"), F.min("readable").alias("readable"),
    )


def _local_fold(version: list[str]):
    """Folds cells before they are shuffled, some rows at a time: a cell read again and again leaves a task as a few rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def small() -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            order = pc.sort_indices(t, sort_keys=[(v, "ascending") for v in (*version, "entry")], null_placement="at_start")
            t = t.take(order)
            at = pc.if_else(t["readable"], pa.array(np.arange(t.num_rows)), None)
            g = t.select(["run", "entity", "attribute", "code", "readable"]).append_column("at", at)
            g = g.group_by(["run", "entity", "attribute"]).aggregate([("code", "min"), ("code", "max"), ("readable", "all"), ("at", "max")])
            last = t.select([*version, "entry"]).take(g["at_max"])
            differs = pc.fill_null(pc.not_equal(g["code_min"], g["code_max"]), False)
            columns = [g["run"], g["entity"], g["attribute"], *last.columns, g["code_min"], g["readable_all"], differs]
            return pa.table(columns, names=["run", "entity", "attribute", *version, "entry", "code", "readable", "differs"]).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= FOLDED:
                yield from small()
                held, rows = [], 0
        if held:
            yield from small()

    return fold


def sparse(rows: DataFrame, types: dict[str, str], entity: str, attribute: str, value: str, version: list[str], load: str | None, buckets: int) -> DataFrame:
    """(run, entity, cells): the batch as sparse wide deltas, one row per load and entity, hashed by entity into buckets."""
    run = F.coalesce(F.col(f"`{load}`").cast("string"), F.lit("")) if load else F.lit("")
    cells = deltas(rows.withColumn("\trun", run), types, entity, attribute, value, version, "\trun")
    cells = cells.select(
        "run", "entity", "attribute", F.when(F.col("readable"), F.struct("version", "entry")).alias("latest"), "code", F.lit(False).alias("differs"), "readable",
    )
    local = cells.select("run", "entity", "attribute", "latest.version.*", "latest.entry", "code", "readable")
    names = [f"v{i}" for i in range(len(version))]
    local = local.toDF("run", "entity", "attribute", *names, "entry", "code", "readable")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in local.schema.fields) + ", differs boolean"
    spread = local.mapInArrow(_local_fold(names), schema).repartition(buckets, "entity")
    latest = F.when(F.col("entry").isNotNull(), F.struct(F.struct(*names).alias("version"), "entry")).alias("latest")
    folded = _fold(spread.select("run", "entity", "attribute", latest, "code", "differs", "readable"), "run")
    return folded.groupBy("run", "entity").agg(F.sort_array(F.collect_list(F.struct(*CELL))).alias("cells"))


class Log:
    """The runs of a wide table, at path (a shared folder)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{checkpoint_dir(spark)}/quernel-wide-{uuid.uuid4().hex}"
        self.name = f"quernel_wide_{uuid.uuid4().hex}"
        try:  # buckets are known to tables of a catalog only
            self.bucketed = spark.catalog.databaseExists("default")
        except Exception:  # noqa: BLE001  a session whose catalog can't be used (no folder of its own)
            self.bucketed = False

    def _write(self, wide: DataFrame) -> None:
        sorted_runs = wide if self.bucketed else wide.sortWithinPartitions("run", "entity")  # a bucketed write sorts by itself
        out = sorted_runs.write.partitionBy("run").option("compression", "zstd").mode("append")
        if self.bucketed:
            out.bucketBy(self.buckets, "entity").sortBy("entity").option("path", self.path).format("parquet").saveAsTable(self.name)
        else:
            out.parquet(self.path)

    def _cells(self) -> DataFrame:
        """The cells of all runs, merged; without buckets that takes a shuffle."""
        runs = self.spark.table(self.name) if self.bucketed else self.spark.read.parquet(self.path)
        return _fold(runs.select("entity", F.explode("cells").alias("c")).select("entity", "c.*"))

    def drop(self) -> None:
        """Forgets the table; its files stay for who still reads them."""
        if self.bucketed:
            self.spark.sql(f"drop table if exists `{self.name}`")

    def upsert(self, rows: DataFrame, types: dict[str, str], entity: str, attribute: str, value: str, version: list[str], load: str | None = None) -> Log:
        """A run per load of a batch; runs that are there are not read."""
        self._write(sparse(rows, types, entity, attribute, value, version, load, self.buckets))
        return self

    def cells(self) -> DataFrame:
        """All runs merged: one row per cell, the latest readable entry, whether entries conflict or can't be read."""
        return self._cells().select(
            "entity", "attribute", F.col("latest.entry").alias("entry"), F.col("differs").alias("conflict"), (~F.col("readable")).alias("unreadable"),
        )

    def compact(self) -> Log:
        """A log of one run, with the same cells; this one stays as it is."""
        out = Log(self.spark, buckets=self.buckets)
        out.bucketed = self.bucketed
        out._write(self._cells().groupBy("entity").agg(F.collect_list(F.struct(*CELL)).alias("cells")).withColumn("run", F.lit("")))
        return out


def issues(cells: DataFrame) -> DataFrame:
    """(entity, attribute, issue) of compacted cells."""
    found = F.array_compact(F.array(F.when(F.col("conflict"), F.lit("conflict")), F.when(F.col("unreadable"), F.lit("unreadable"))))
    return cells.filter("conflict or unreadable").select("entity", "attribute", F.explode(found).alias("issue"))


def widen(cells: DataFrame, types: dict[str, str], entity_name: str) -> DataFrame:
    """One row per entity and one typed column per attribute of the dictionary."""
    names = sorted(types)
    wide = side_by_side(cells, ["entity"], "attribute", "entry", names)
    typed = []
    for i, a in enumerate(names):
        c = F.col(f"_h{i}")
        if types[a] == "boolean":
            c = F.when(F.lower(c).isin(*TRUE), True).when(F.lower(c).isin(*FALSE), False)
        elif types[a] != "string":
            c = c.try_cast(types[a])
        typed.append(c.alias(a + "_" if a.lower() == entity_name.lower() else a))
    return wide.select(F.col("entity").alias(entity_name), *typed)
