"""One query per feature of readers, sinks, the command line and streams: a table goes out as text or a workbook and comes back.

Files lie in the session's checkpoint folder, written by the executors where a format allows.
"""

from __future__ import annotations

import lzma
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel import cli, streaming
from quernel.operators import cut, keep, mutate
from quernel.runtime import checkpoint_dir, table
from quernel.sources import text, xlsx
from quernel.table import Table

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        _ALL[name] = build, sql
        return build

    return register


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/quernel-files-{uuid.uuid4().hex}"


def _written(df: DataFrame, *lines: Column, compression: str = "none", files: int | None = None) -> str:
    """A folder of text files with the lines of each row, in the order of the columns given."""
    path = _folder(df.sparkSession)
    out = df.select(F.explode(F.array(*lines)).alias("value"))
    (out.coalesce(files) if files else out).write.option("compression", compression).text(path)
    return path


def _tabbed(*cols: str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in cols])


_CUSTOMER = "c_custkey", "c_name", "c_mktsegment"
_CUSTOMER_SQL = "select c_custkey::varchar as {}, c_name as {}, c_mktsegment as {} from customer"
_PLAIN = _CUSTOMER_SQL.format(*_CUSTOMER)
_NUMBERED = _CUSTOMER_SQL.format("col1", "col2", "col3")


@query("source_tsv", _PLAIN)
def source_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    text.write(Table.of(table(spark, d, "customer").select(*_CUSTOMER), ["c_custkey"]), path, ordered=True)
    return text.read(spark, path, strict=True).to_df()


@query("source_gzip", _NUMBERED)
def source_gzip(spark: SparkSession, d: str) -> DataFrame:
    return text.read(spark, _written(table(spark, d, "customer"), _tabbed(*_CUSTOMER), compression="gzip"), header=False).to_df()


@query("source_xz", "select n_nationkey::varchar as n_nationkey, n_name from nation")
def source_xz(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}.tsv.xz"
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # as many as there are nations
    Path(path.removeprefix("file:")).write_bytes(lzma.compress("\n".join(["n_nationkey\tn_name", *[f"{r[0]}\t{r[1]}" for r in rows]]).encode()))
    return text.read(spark, path).to_df()


@query("source_csv", "select p_partkey::varchar as col1, p_name || '; \"' || p_brand || '\"' as col2, coalesce(nullif(p_type, ''), 'NA') as col3 from part")
def source_csv(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), "p_name", F.lit('; ""'), "p_brand", F.lit('"""'))
    return text.read(spark, _written(table(spark, d, "part"), F.concat_ws(";", F.col("p_partkey").cast("string"), quoted, "p_type")), sep=";", header=False, na="NA").to_df()


@query("source_comments", _NUMBERED)
def source_comments(spark: SparkSession, d: str) -> DataFrame:
    path = _written(table(spark, d, "customer"), F.concat(F.lit("%"), "c_name"), _tabbed(*_CUSTOMER), F.lit(""))
    return text.read(spark, path, header=False, comment="%").to_df()


@query("source_empty_rows", _NUMBERED)
def source_empty_rows(spark: SparkSession, d: str) -> DataFrame:
    return text.read(spark, _written(table(spark, d, "customer"), _tabbed(*_CUSTOMER), F.lit(" \t\t")), header=False, skip_empty=True).to_df()


@query("source_ragged_dropped", _NUMBERED)
def source_ragged_dropped(spark: SparkSession, d: str) -> DataFrame:
    path = _written(table(spark, d, "customer"), _tabbed(*_CUSTOMER), F.col("c_name"), _tabbed(*_CUSTOMER, "c_nationkey"))
    return text.read(spark, path, header=False, skip_ragged=True).to_df()


@query("source_ragged_filled", _NUMBERED + " union all select c_custkey::varchar, '', '' from customer")
def source_ragged_filled(spark: SparkSession, d: str) -> DataFrame:
    path = _written(table(spark, d, "customer"), _tabbed(*_CUSTOMER, "c_nationkey"), F.col("c_custkey").cast("string"), files=1)
    return text.read(spark, path, header=False).to_df().select("col1", "col2", "col3")


@query("source_line_ends", "select o_orderkey::varchar as col1, o_orderstatus || chr(10) || o_orderpriority as col2 from orders")
def source_line_ends(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat(F.col("o_orderkey").cast("string"), F.lit('\t"'), "o_orderstatus", F.lit("\n"), "o_orderpriority", F.lit('"'))
    return text.read(spark, _written(table(spark, d, "orders"), both), header=False, multiline=None).to_df()


@query("source_folder", _PLAIN)
def source_folder(spark: SparkSession, d: str) -> DataFrame:
    """A file per market segment, each with a header."""
    path = _folder(spark)
    rows = table(spark, d, "customer").select("c_mktsegment", F.lit(1).alias("k"), _tabbed(*_CUSTOMER).alias("value"))
    heads = table(spark, d, "customer").select("c_mktsegment").distinct().select("c_mktsegment", F.lit(0).alias("k"), F.lit("\t".join(_CUSTOMER)).alias("value"))
    both = rows.unionByName(heads).repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "k")
    both.select("c_mktsegment", "value").withColumnRenamed("c_mktsegment", "segment").write.partitionBy("segment").text(path)
    return text.read(spark, f"{path}/*").to_df()


@query("sink_lines", "select concat_ws(chr(9), c_custkey, c_name, c_mktsegment) as value from customer")
def sink_lines(spark: SparkSession, d: str) -> DataFrame:
    return text.rendered(Table.of(table(spark, d, "customer").select(*_CUSTOMER), ["c_custkey"])).select("value")


_RULE = "'+' || repeat('-', 13) || '+' || repeat('-', 13) || '+'"


@query("sink_pretty", f"""
select {_RULE} as line union all select '| r_regionkey | r_name      |' union all select {_RULE}
union all select '| ' || rpad(r_regionkey::varchar, 11, ' ') || ' | ' || rpad(r_name, 11, ' ') || ' |' from region union all select {_RULE}""")
def sink_pretty(spark: SparkSession, d: str) -> DataFrame:
    shown = text.pretty(Table.of(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"]))
    return spark.createDataFrame([(x,) for x in shown.split("\n")], "line string")


def _workbook(spark: SparkSession, d: str) -> str:
    path = f"{_folder(spark)}.xlsx"
    customer = Table.of(table(spark, d, "customer").select(*_CUSTOMER), ["c_custkey"])
    xlsx.write(path.removeprefix("file:"), {"customer": customer, "nation": Table.of(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])})
    return path


@query("sheet_dump", _PLAIN)
def sheet_dump(spark: SparkSession, d: str) -> DataFrame:
    return xlsx.read(spark, _workbook(spark, d)).to_df()


@query("sheet_fields", "select c_custkey::varchar as c_custkey, c_mktsegment from customer order by customer.c_custkey limit 50 offset 9")
def sheet_fields(spark: SparkSession, d: str) -> DataFrame:
    return xlsx.read(spark, _workbook(spark, d), "customer", fields="A,c_mktsegment", rows="10:59").to_df()


@query("sheet_list", "select 1 as number, 'customer' as name, count(*) + 1 as rows, 3 as columns from customer union all select 2, 'nation', count(*) + 1, 2 from nation")
def sheet_list(spark: SparkSession, d: str) -> DataFrame:
    found = [s[:4] for s in xlsx.list_sheets(_workbook(spark, d).removeprefix("file:"))]
    return spark.createDataFrame(found, "number int, name string, rows bigint, columns int")


@query("sheet_preview", "select n_nationkey || chr(9) || n_name as line from nation where n_nationkey < 4 union all select '#2 nation' union all select 'n_nationkey' || chr(9) || 'n_name'")
def sheet_preview(spark: SparkSession, d: str) -> DataFrame:
    shown = xlsx.preview(_workbook(spark, d).removeprefix("file:"), ["nation"], rows=4)
    return spark.createDataFrame([(x,) for x in shown.split("\n")], "line string")


@query("command_line", "select c_mktsegment, count(*)::varchar as \"c_custkey_count\", max(c_custkey)::varchar as \"c_custkey_max\" from customer group by 1")
def command_line(spark: SparkSession, d: str) -> DataFrame:
    path = _written(table(spark, d, "customer"), _tabbed("c_custkey", "c_mktsegment"))
    args = cli._parser().parse_args(["summarize", "-H", "-g", "2", "-s", "1=count,max", path])
    t = cli.run(args, spark, path)
    names = "c_mktsegment", "c_custkey_count", "c_custkey_max"
    return t.df.select(*[t.cell(i).text.alias(n) for i, n in enumerate(names)])


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """What a stream comes to once all that is there has gone through it."""
    path = _folder(df.sparkSession)
    writer = df.writeStream.option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).start().awaitTermination()
    return df.sparkSession.read.parquet(path)


@query("stream_windows", """
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, round(sum(value), 3) as value_sum, count(*)::double as value_count, round(max(value), 3) as value_max from events group by 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    events = _stream(spark, d, "events")
    out = _drained(streaming.summarize_windows(events, "ts", "1 hour", ["value=sum,count,max"], "event_type"), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", F.round("value_sum", 3).alias("value_sum"), "value_count", F.round("value_max", 3).alias("value_max"))


@query("stream_rows", "select event_id, user_id * 2.0::double as twice from events where event_type <> 'click' and user_id > 10")
def stream_rows(spark: SparkSession, d: str) -> DataFrame:
    t = keep(streaming.stream_table(_stream(spark, d, "events")), '$event_type != "click" & $user_id > 10')
    return _drained(cut(mutate(t, "twice=$user_id * 2"), "event_id,twice").to_df(), "append")


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items()}
