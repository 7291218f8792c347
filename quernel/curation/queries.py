"""The queries of the general training-data problems (2, 3, 5 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.curation import impute, orphans, quality, wide
from quernel.runtime import table

PCT = (0.0, True, 100.0)
PROFILED = {"qc": {"reads_millions": (0.0, False, None), "duplication_pct": PCT}, "samples": {"contamination_pct": PCT}}


def _profiled(d: str) -> dict:
    return {t: (f"{d}/{t}.parquet", cols) for t, cols in PROFILED.items()}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.outliers(quality.profile(spark, _profiled(d), "load_id"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.profile(spark, _profiled(d), "load_id").select(
        "tbl", "col_name", "load_id", "rows_n", "missing_n", "unreadable_n", "outside_n", "distinct_n", "lowest", "highest", F.round("median", 6).alias("median")
    )


def p2_footers(spark: SparkSession, d: str) -> DataFrame:
    """Rows and NULLs of each column, from footers alone."""
    return quality.chunks(spark, _profiled(d), "load_id").select("tbl", "col_name", "rows_n", "nulls_n")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return impute.filled_cells(_imputed(spark, d), "rec_id").select("rec_id", "field_name")


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its cells filled and a mark for each filled cell."""
    return _imputed(spark, d)


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per field: cells marked as filled, and cells left without a value."""
    parts = [f"struct('{f}' as field_name, {f}_filled as filled, {f} is null as empty)" for f in ("bmi", "smoker_status", "site")]
    cells = _imputed(spark, d).select(F.explode(F.array(*[F.expr(p) for p in parts])).alias("c"))
    return cells.groupBy("c.field_name").agg(F.count_if("c.filled").alias("filled_n"), F.count_if("c.empty").alias("empty_n"))


def p3_plausible(spark: SparkSession, d: str) -> DataFrame:
    """Per field whether fills look like the rest: statuses and sites that occur, bmi in bounds, spread by half to twice as much as the kept ones."""
    filled = _imputed(spark, d)
    spread = F.stddev(F.when(F.col("bmi_filled"), F.col("bmi"))) / F.stddev(F.when(~F.col("bmi_filled"), F.col("bmi")))
    out = filled.agg(F.lit("bmi").alias("field_name"), (spread.between(0.5, 2.0) & F.min("bmi").between(10, 80) & F.max("bmi").between(10, 80)).alias("plausible"))
    for f in ("smoker_status", "site"):
        by_value = filled.groupBy(f).agg(F.count_if(~F.col(f"{f}_filled")).alias("kept"), F.count_if(f"{f}_filled").alias("made"))
        out = out.unionByName(by_value.agg(F.lit(f).alias("field_name"), (F.count_if((F.col("made") > 0) & (F.col("kept") == 0)) == 0).alias("plausible")))
    return out


def _imputed(spark: SparkSession, d: str) -> DataFrame:
    return impute.impute(table(spark, d, "subjects"), impute.SUBJECTS)


REFERENCES = {"samples": ("subject_id", "subjects", "subject_id"), "qc": ("sample_id", "samples", "sample_id"), "cytokines": ("sample_id", "samples", "sample_id")}


def _orphans(spark: SparkSession, d: str, rows: bool) -> DataFrame:
    out = None
    for t, (key, parent, parent_key) in REFERENCES.items():
        folded = orphans.fold_parent(table(spark, d, parent), parent_key, "loaded_at", "deleted_at")
        child = table(spark, d, t)
        part = orphans.orphan_rows(child, key, "loaded_at", folded, "rec_id") if rows else orphans.orphan_counts(child, key, "loaded_at", folded)
        part = part.select(F.lit(t).alias("tbl"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d, True)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d, False)


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    types = wide.attribute_types(table(spark, d, "genes"), "gene", "value_type")
    log = wide.Log(spark).upsert(table(spark, d, "expression"), types, "sample_id", "gene", "expression", ["loaded_at", "rec_id"], "load_id")
    return log.cells(), types


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cells, _ = _cells(spark, d)
    return wide.issues(cells).select(F.col("entity").alias("sample_id"), F.col("attribute").alias("gene"), "issue")


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    cells, types = _cells(spark, d)
    return wide.widen(cells, types, "sample_id")


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """What p6_wide comes to per sample: how many cells of each type, and their sums."""
    types = wide.attribute_types(table(spark, d, "genes"), "gene", "value_type")
    of = lambda kind: [F.col(f"`{a}`") for a, k in sorted(types.items()) if k == kind]
    count = lambda cs: sum([c.isNotNull().cast("bigint") for c in cs], F.lit(0).cast("bigint"))
    total = lambda cs, zero: sum([F.coalesce(c, zero) for c in cs], zero)
    return p6_wide(spark, d).select(
        "sample_id", count(of("double")).alias("doubles"), F.round(total(of("double"), F.lit(0.0)), 3).alias("double_sum"), count(of("bigint")).alias("bigints"),
        total(of("bigint"), F.lit(0).cast("bigint")).alias("bigint_sum"), total([c.cast("bigint") for c in of("boolean")], F.lit(0).cast("bigint")).alias("trues"),
        count(of("boolean")).alias("booleans"), count(of("string")).alias("strings"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_profile, p2_footers, p3_found, p3_filled, p3_totals, p3_plausible, p5_found, p5_counts, p6_found, p6_wide, p6_totals)}


_P2 = r"""
with cells as (
  select 'qc' as tbl, 'reads_millions' as col_name, load_id, reads_millions as t from qc
  union all select 'qc', 'duplication_pct', load_id, duplication_pct from qc
  union all select 'samples', 'contamination_pct', load_id, case when isnan(contamination_pct) then 'NaN' else contamination_pct::varchar end from samples),
r as (
  select tbl, col_name, load_id, coalesce(trim(t, E' \t'), '') = '' as missing,
    case when regexp_full_match(trim(t, E' \t'), '[+-]?[0-9]+(\.[0-9]+)?') or tbl = 'samples' and t <> 'NaN' then try_cast(trim(t, E' \t') as double) end as v
  from cells),
s as (select *, v is not null and case when col_name = 'reads_millions' then v > 0 else v between 0 and 100 end as fits from r),
p as (
  select tbl, col_name, load_id, count(*) as rows_n, count(*) filter (missing) as missing_n,
    count(*) filter (not missing and v is null) as unreadable_n, count(*) filter (v is not null and not fits) as outside_n,
    count(*) filter (fits) as inside_n, count(distinct v) as distinct_n, min(v) as lowest, max(v) as highest,
    median(v) filter (fits) as med
  from s group by 1, 2, 3),
m as (
  select tbl, col_name, load_id, max(n) as most_n from (select tbl, col_name, load_id, v, count(*) as n from s where fits group by all) group by 1, 2, 3),
c as (select tbl, col_name, median(med) as centre from p group by 1, 2)
"""

_P5 = r"""
with parents as (
  select 'samples' as tbl, upper(trim(subject_id, E' \t')) as k, loaded_at as l, deleted_at as x from subjects
  union all select 'qc', upper(trim(sample_id, E' \t')), loaded_at, deleted_at from samples
  union all select 'cytokines', upper(trim(sample_id, E' \t')), loaded_at, deleted_at from samples),
folded as (
  select tbl, k, min(l) as first_l, bool_or(l is null) as always, bool_or(x is null) as alive, max(x) as last_x from parents where k <> '' group by 1, 2),
refs as (
  select 'samples' as tbl, rec_id, upper(trim(subject_id, E' \t')) as k, loaded_at as t from samples
  union all select 'qc', rec_id, upper(trim(sample_id, E' \t')), loaded_at from qc
  union all select 'cytokines', rec_id, upper(trim(sample_id, E' \t')), loaded_at from cytokines),
j as (select r.tbl, r.rec_id, r.t, f.k is null as missing, not always and first_l > t as late, not alive and last_x <= t as deleted
  from refs r left join folded f on r.tbl = f.tbl and r.k = f.k where r.k <> ''),
o as (select tbl, rec_id, t, 'missing' as reason from j where missing
  union all select tbl, rec_id, t, 'late' from j where late
  union all select tbl, rec_id, t, 'deleted' from j where deleted)
"""

_P6 = r"""
with e as (
  select upper(trim(sample_id, E' \t')) as s, upper(trim(x.gene, E' \t')) as g, trim(expression, E' \t\n\r') as t, loaded_at, rec_id from expression x),
k as (select e.*, coalesce(value_type, 'string') as kind from e left join genes on g = genes.gene where s <> '' and g <> '' and t <> ''),
v as (
  select *, case kind when 'double' then regexp_full_match(t, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') when 'bigint' then regexp_full_match(t, '[+-]?[0-9]+')
    when 'boolean' then lower(t) in ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0') else true end as ok,
    case kind when 'double' then (try_cast(t as double) + 0)::varchar when 'bigint' then try_cast(t as hugeint)::varchar
    when 'boolean' then (lower(t) in ('true', 't', 'yes', 'y', '1'))::varchar else t end as val from k),
c as (select s, g, kind, count(distinct val) filter (ok) > 1 as conflict, bool_or(not ok) as unreadable, arg_max(t, (loaded_at, rec_id)) filter (ok) as latest from v group by 1, 2, 3)
"""

#: What stands for "nothing is known", letters only, in lower case.
_UNKNOWN_SQL = "('', 'na', 'nan', 'null', 'none', 'nil', 'unk', 'unknown', 'notrecorded', 'tbd', 'notknown', 'missing')"


def _letters(c: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace(lower({c}), '[^a-z]', '', 'g'), '^(unknown)(site|smoker|status)+$', '\\1'), '') in {_UNKNOWN_SQL}"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + """
select tbl, col_name, load_id, unnest(list_filter([
    case when missing_n > 0.1 * rows_n then 'missing' end, case when unreadable_n > 0.05 * (rows_n - missing_n) then 'unreadable' end,
    case when outside_n > 0.05 * (rows_n - missing_n - unreadable_n) then 'range' end, case when most_n > 0.2 * inside_n then 'frequent' end,
    case when abs(med - centre) > 0.25 * abs(centre) then 'shift' end], lambda x: x is not null)) as issue
from p left join m using (tbl, col_name, load_id) left join c using (tbl, col_name)""",
        "p2_profile": _P2 + "select tbl, col_name, load_id, rows_n, missing_n, unreadable_n, outside_n, distinct_n, lowest, highest, round(med, 6) as median from p",
        "p2_footers": """
select 'qc' as tbl, 'reads_millions' as col_name, count(*) as rows_n, count(*) - count(reads_millions) as nulls_n from qc
union all select 'qc', 'duplication_pct', count(*), count(*) - count(duplication_pct) from qc
union all select 'samples', 'contamination_pct', count(*), count(*) - count(contamination_pct) from samples""",
        "p3_plausible": "select unnest(['bmi', 'smoker_status', 'site']) as field_name, true as plausible",
        "p3_totals": f"""
select 'bmi' as field_name, count(*) filter (bmi is null or isnan(bmi) or bmi not between 10 and 80) as filled_n, 0 as empty_n from subjects
union all select 'smoker_status', count(*) filter ({_letters('smoker_status')}), 0 from subjects
union all select 'site', count(*) filter ({_letters('site')}), 0 from subjects""",
        "p3_found": f"""
select rec_id, 'bmi' as field_name from subjects where bmi is null or isnan(bmi) or bmi not between 10 and 80
union all select rec_id, 'smoker_status' from subjects where {_letters('smoker_status')}
union all select rec_id, 'site' from subjects where {_letters('site')}""",
        "p5_found": _P5 + "select tbl, rec_id, reason from o",
        "p5_counts": _P5 + "select tbl, strftime(t, '%Y-%m') as month, reason, count(*) as n from o group by 1, 2, 3",
        "p6_totals": _P6 + """
select s as sample_id, count(try_cast(latest as double)) filter (kind = 'double') as doubles, round(coalesce(sum(try_cast(latest as double)) filter (kind = 'double'), 0), 3) as double_sum,
  count(try_cast(latest as bigint)) filter (kind = 'bigint') as bigints, coalesce(sum(try_cast(latest as bigint)) filter (kind = 'bigint'), 0)::bigint as bigint_sum,
  count(*) filter (kind = 'boolean' and lower(latest) in ('true', 't', 'yes', 'y', '1')) as trues, count(latest) filter (kind = 'boolean') as booleans,
  count(latest) filter (kind = 'string' and g in (select gene from genes)) as strings
from c group by 1""",
        "p6_found": _P6 + "select s as sample_id, g as gene, 'conflict' as issue from c where conflict union all select s, g, 'unreadable' from c where unreadable",
    }
