"""The queries of the language-model training-data problems (1, 4, 7, 8, 9 and 10) and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import components, digest, leakage, packing, shapes, topn
from quernel.runtime import cut, real_key, table

QS = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
TOKENIZERS = os.environ.get("QUERNEL_TOKENIZERS", "/opt/tokenizers")
CAPACITY = 2048


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """(measure, grp, load_id, value): purity of samples, mapped_pct of their checks; groups without case and blanks."""
    s = table(spark, d, "samples").select(
        real_key(F.col("sample_id")).alias("k"), F.lower(F.trim("group")).alias("grp"), "purity", "load_id", "loaded_at", "rec_id"
    )
    # A sample's checks count for the group of its latest delivery.
    of_sample = s.filter("k is not null").groupBy("k").agg(F.max_by("grp", F.struct("loaded_at", "rec_id")).alias("grp"))
    qc = table(spark, d, "qc").select(real_key(F.col("sample_id")).alias("k"), "load_id", F.col("mapped_pct").alias("value"))
    mapped = qc.join(of_sample, "k").select(F.lit("mapped_pct").alias("measure"), "grp", "load_id", "value")
    return s.select(F.lit("purity").alias("measure"), "grp", "load_id", F.col("purity").alias("value")).unionByName(mapped)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    values, keys = cut(_measures(spark, d)), ["measure", "grp"]  # joined once, read by both passes
    partial = digest.digest(values, [*keys, "load_id"], "value")
    estimates = digest.quantiles(digest.merge(partial, keys), keys, QS)
    return digest.certify(values, keys, "value", estimates)


def p1_certificates(spark: SparkSession, d: str) -> DataFrame:
    """What of p1_percentiles SQL can tell: the values counted, and that every estimate is within the bound."""
    return p1_percentiles(spark, d).select("measure", "grp", "q", "n", "certified")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_names(table(spark, d, "scores"), "subject", "name", "score", 3).select(F.col("grp").alias("subject"), "name")


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "samples").select("rec_id", real_key(F.col("sample_id")).alias("sample"), real_key(F.col("subject_id")).alias("subject"))
    return s, components.components(components.star_edges(s, "sample", "subject"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, c = _people(spark, d)
    other = c.select("root", F.col("v").alias("subject_b"))
    return c.withColumnRenamed("v", "subject_a").join(other, "root").filter("subject_a < subject_b").select("subject_a", "subject_b")


def p7_split(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, part) of every record of samples; a record without a subject goes with its sample's."""
    s, c = _people(spark, d)
    of_sample = s.filter("sample is not null and subject is not null").groupBy("sample").agg(F.min("subject").alias("via"))
    rows = s.join(of_sample, "sample", "left").withColumn("subject", F.coalesce("subject", "via"))
    rows = rows.join(c.withColumnRenamed("v", "subject"), "subject", "left").select(
        "rec_id", F.coalesce("root", "subject", F.concat(F.lit("sample "), "sample"), F.concat(F.lit("record "), F.col("rec_id").cast("string"))).alias("person")
    )
    parts = components.split(rows.groupBy("person").agg(F.count(F.lit(1)).alias("n")), "person", "n", {"train": 0.8, "validation": 0.1, "test": 0.1})
    return rows.join(parts, "person").select("rec_id", "part")


def p7_members(spark: SparkSession, d: str) -> DataFrame:
    """(person, subject, links): each subject with samples linked to others, under its component's id: as many rows as subjects."""
    s, c = _people(spark, d)
    edges = components.star_edges(s, "sample", "subject")
    ends = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("links"))
    least = c.groupBy("root").agg(F.min("v").alias("person"))  # a name that does not depend on hashes
    return c.join(ends, "v").join(least, "root").select("person", F.col("v").alias("subject"), "links")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What of p7_split SQL can tell: all records are in a part, no subject is in two, and shares are within one in a hundred."""
    s = table(spark, d, "samples").select("rec_id", real_key(F.col("subject_id")).alias("subject"))
    rows = p7_split(spark, d).join(s, "rec_id")
    torn = rows.filter("subject is not null").groupBy("subject").agg(F.count_distinct("part").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn_n"))
    share = lambda p, x: F.abs(F.count_if(F.col("part") == p) / F.count(F.lit(1)) - x) < 0.01
    return rows.agg(F.count(F.lit(1)).alias("records_n"), (share("train", 0.8) & share("validation", 0.1) & share("test", 0.1)).alias("close")).crossJoin(F.broadcast(torn))  # one row each


def p8_certificates(spark: SparkSession, d: str) -> DataFrame:
    """What of p8_containers SQL can tell: pages packed, containers over capacity, pages divided without need, tokens that went astray, and whether nine tenths of the room are used."""
    packed = p8_containers(spark, d)
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > CAPACITY).alias("over_n"), (F.sum("t") / F.count_if(F.col("t") > 0) > 0.9 * CAPACITY).alias("full"))
    pages = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    divided = (F.col("pieces") > 1) & (F.col("t") <= CAPACITY)
    return pages.agg(F.count(F.lit(1)).alias("pages_n"), F.count_if(divided).alias("divided_n"), F.count_if(F.col("t") != F.col("end")).alias("astray_n")).crossJoin(F.broadcast(bins))  # one row each


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    import importlib.util

    spec = importlib.util.spec_from_file_location("vocabulary_files", f"{TOKENIZERS}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", CAPACITY, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", files.PATTERN)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "page_lines"), table(spark, d, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shapes.judge_pages(table(spark, d, "documents"), "doc_id", "text").filter("flagged").select("doc_id")


_P7 = """
with recursive m as (
  select distinct upper(trim(sample_id, E' \\t')) as k, upper(trim(subject_id, E' \\t')) as v from samples
  where trim(sample_id, E' \\t') <> '' and trim(subject_id, E' \\t') <> ''),
e as (select distinct x.v as a, y.v as b from m x join m y on x.k = y.k and x.v <> y.v),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
tied as (select distinct m.v, l.least from m join (select k, min(v) as least from m group by k) l using (k) where m.v <> l.least),
star as (select v from tied union all select least from tied)"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_percentiles, p1_certificates, p4_found, p7_found, p7_members, p7_split, p7_shares, p8_containers, p8_certificates, p9_found, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_certificates": f"""
with s as (select nullif(upper(trim(sample_id, E' \\t')), '') as k, lower(trim("group", ' ')) as grp, purity, loaded_at, rec_id from samples),
g as (select k, first(grp order by loaded_at desc, rec_id desc) as grp from s where k is not null group by k),
v as (select 'purity' as measure, grp, purity as x from s
  union all select 'mapped_pct', g.grp, mapped_pct from qc join g on g.k = upper(trim(qc.sample_id, E' \\t')))
select measure, grp, q, count(*) as n, true as certified from v, (select unnest({QS}::double[]) as q)
where x is not null and not isnan(x) and not isinf(x) group by measure, grp, q""",
        "p4_found": """
with v as (select subject, name, max(score) as best from scores
  where subject is not null and name is not null and score is not null and not isnan(score) and not isinf(score) group by 1, 2)
select subject, name from v qualify row_number() over (partition by subject order by best desc, encode(name)) <= 3""",
        "p7_members": f"""{_P7}
select least(subject, min(other)) as person, subject, any_value(links) as links from (
  select a as subject, b as other from r where a <> b) join (select v as subject, count(*) as links from star group by 1) using (subject) group by subject""",
        "p7_shares": "select count(*) as records_n, true as close, 0 as torn_n from samples",
        "p8_certificates": "select count(*) as pages_n, 0 as divided_n, 0 as astray_n, 0 as over_n, true as full from documents",
        "p7_found": f"""{_P7}
select distinct a as subject_a, b as subject_b from r where a < b""",
    }
