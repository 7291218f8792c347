"""One query per table operator and option, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import cut, info, join, keep, melt, mutate, pivot, sort, summarize, take
from quernel.runtime import table
from quernel.table import Table

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def query(name: str, sql: str | None, build: Callable[[Callable], Table], digits: int = 4) -> None:
    """Registers build(load); load(name, order_by) gives a table. Doubles are rounded to some digits."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        def load(n: str, order_by=None, columns=None) -> Table:
            df = table(spark, d, n)
            return Table.of(df.select(*columns) if columns else df, order_by)

        df = build(load).to_df()
        return df.select(*[_rounded(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])

    _ALL[name] = run, _rounded_sql(sql) if sql else None


def _rounded(c: Column, digits: int) -> Column:
    """Rounded the same way as in the SQL; a little more than one half, so that noise in the last bit decides nothing."""
    return F.floor(c * 10.0**digits + 0.501).cast("double") / 10.0**digits


def _rounded_sql(sql: str) -> str:
    """SQL with each round(x, n) written out as in _rounded."""
    out, i = [], 0
    while (at := sql.find("round(", i)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, digits = sql[at + 6 : end - 1].rsplit(",", 1)
        out += [sql[i:at], f"(floor(({_rounded_sql(inner)}) * 1e{int(digits)} + 0.501) / 1e{int(digits)})"]
        i = end
    return "".join([*out, sql[i:]])


# ---------------------------------------------------------------- cut

query("cut_names", "select c_name, c_mktsegment from customer", lambda t: cut(t("customer"), "c_name,c_mktsegment"))
query("cut_positions", "select o_orderstatus, o_orderkey from orders", lambda t: cut(t("orders"), "3,1"))
query("cut_from_end", "select o_orderpriority, o_orderdate from orders", lambda t: cut(t("orders"), "-1,-2"))
query("cut_ranges", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer", lambda t: cut(t("customer"), ":c_name,c_acctbal:"))
query("cut_all_but_last", "select p_partkey, p_name, p_brand, p_type, p_size from part", lambda t: cut(t("part"), ":-2"))
query("cut_repeated", 'select n_name, n_nationkey, n_name as "n_name#2" from nation', lambda t: cut(t("nation"), "n_name,n_nationkey,`n_name`"))

query("cut_trailing_comma", "select c_name, c_custkey from customer", lambda t: cut(t("customer"), "c_name,c_custkey,"))

# ---------------------------------------------------------------- filter

_LINE = "l_orderkey,l_linenumber,l_quantity,l_extendedprice"
_LINE_SQL = "select l_orderkey, l_linenumber, l_quantity, round(l_extendedprice, 4) as l_extendedprice from lineitem where "


def _filter(name: str, expression: str, sql: str) -> None:
    query(f"filter_{name}", _LINE_SQL + sql, lambda t: cut(keep(t("lineitem"), expression), _LINE))


_filter("compare", "$l_quantity <= 24", "l_quantity <= 24")
_filter("chain", "10 < $l_quantity < 20", "l_quantity > 10 and l_quantity < 20")
_filter("logic", '$l_returnflag == "R" & !($l_quantity < 10 | $l_discount > 0.05)', "l_returnflag = 'R' and not (l_quantity < 10 or l_discount > 0.05)")
_filter("words", '$l_returnflag == "A" and not $l_quantity > 5 or $l_tax > 0.075', "(l_returnflag = 'A' and not l_quantity > 5) or l_tax > 0.075")
_filter("arithmetic", "$l_extendedprice * (1 - $l_discount) + $l_tax > 50000", "l_extendedprice * (1 - l_discount) + l_tax > 50000")
_filter("power", "-$l_discount^2 + 2^3^0 > 1.0025", "l_discount * l_discount + 2 > 1.0025")
_filter("divide_by_zero", "1 / ($l_linenumber - 1) > 0.3", "l_linenumber <> 1 and 1.0 / nullif(l_linenumber - 1, 0) > 0.3")
_filter("functions", "abs($l_quantity - 25) < 3 & sqrt($l_quantity) > 4.9 & log2($l_linenumber) >= 1", "abs(l_quantity - 25) < 3 and sqrt(l_quantity) > 4.9 and log2(l_linenumber) >= 1")
_filter("logarithms", "ln($l_quantity) > 3 & log($l_quantity) < 1.6 & log10($l_quantity) > 1.4 & exp2($l_linenumber) < 9 & exp($l_linenumber) > 3", "ln(l_quantity) > 3 and log10(l_quantity) < 1.6 and log10(l_quantity) > 1.4 and 2 ** l_linenumber < 9 and exp(l_linenumber) > 3")
_filter("text_equal", '$l_linestatus != "O"', "l_linestatus <> 'O'")
_filter("regex", '$l_returnflag ~ "^[AN]$"', "l_returnflag in ('A', 'N')")
_filter("regex_any", '$l_returnflag:$l_linestatus ~ "F"', "l_returnflag like '%F%' or l_linestatus like '%F%'")
_filter("regex_not", '$l_returnflag,$l_linestatus !~ "R|F"', "not (regexp_matches(l_returnflag, 'R|F') or regexp_matches(l_linestatus, 'R|F'))")
_filter("regex_dynamic", "$l_returnflag ~ $l_linestatus | $l_linestatus ~ \"O\"", "l_returnflag = l_linestatus or l_linestatus = 'O'")
_filter("truth", "$l_discount & $l_linenumber > 3", "l_discount <> 0 and l_linenumber > 3")
_filter("row_statistic", "max($l_discount,$l_tax) > 0.09 & mean($l_quantity:$l_discount) > 1000", "greatest(l_discount, l_tax) > 0.09 and (l_quantity + l_extendedprice + l_discount) / 3 > 1000")
_filter("position", "$5 == 7 & $-2 == \"F\"", "l_quantity = 7 and l_linestatus = 'F'")
query("filter_every_column", "select p_partkey, p_name from part where regexp_matches(concat_ws('|', p_partkey::varchar, p_name, p_brand, p_type, p_size::varchar), '77')",
      lambda t: cut(keep(t("part", columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size"]), '~ "77"'), "p_partkey,p_name"))

# ---------------------------------------------------------------- mutate

_K = "l_orderkey,l_partkey,l_suppkey,l_linenumber"


def _mutate(name: str, operations: list[str], show: str, sql: str) -> None:
    query(f"mutate_{name}", f"select {_K}, {sql} from lineitem", lambda t: cut(mutate(t("lineitem"), *operations), f"{_K},{show}"))


_mutate("arithmetic", ["net=$l_extendedprice * (1 - $l_discount)", "gross=$net * (1 + $l_tax)"], "net,gross", "round(l_extendedprice * (1 - l_discount), 4) as net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) as gross")
_mutate("blank", ["x=$l_quantity / ($l_linenumber - 1)", "y=ln($l_discount)", "z=$l_linestatus * 2"], "x,y,z", "round(case when l_linenumber <> 1 then l_quantity / (l_linenumber - 1) end, 4) as x, round(case when l_discount > 0 then ln(l_discount) end, 4) as y, null::double as z")
_mutate("functions", ["a=sqrt($l_quantity)", "b=exp(-$l_discount)", "c=log($l_quantity)", "d=exp2($l_linenumber)", "e=abs(1 - $l_quantity)"], "a:e", "round(sqrt(l_quantity), 4) as a, round(exp(-l_discount), 4) as b, round(log10(l_quantity), 4) as c, 2.0::double ** l_linenumber as d, abs(1 - l_quantity) as e")
_ROW = "l_quantity:l_tax"
_LIST = "[l_quantity, l_extendedprice, l_discount, l_tax]"
_mutate("row_numbers", [f"{n}={n}(${_ROW})" for n in ("sum", "mean", "median", "sd", "min", "max", "prod")] + ["var=var($l_quantity,$l_discount,$l_tax)"], "sum:var",
        f"round(list_sum({_LIST}), 4) as sum, round(list_avg({_LIST}), 4) as mean, round(list_median({_LIST}), 4) as median, round(list_stddev_pop({_LIST}), 4) as sd, round(list_min({_LIST}), 4) as min, round(list_max({_LIST}), 4) as max, round(list_product({_LIST}), 4) as prod, round(list_var_pop([l_quantity, l_discount, l_tax]), 4) as var")
_mutate("row_ranks", ["iqr=iqr($l_quantity:$l_tax)", "q=q25($l_quantity:$l_tax)", "p=p90($l_quantity:$l_tax)", "t=trimmean($l_quantity:$l_tax)", "lo=argmin($l_quantity:$l_tax)", "hi=argmax($l_quantity:$l_tax)", "near=absmin($l_quantity:$l_tax)", "far=absmax($l_quantity:$l_tax)"], "iqr:far",
        f"round(list_aggregate({_LIST}, 'quantile_cont', 0.75) - list_aggregate({_LIST}, 'quantile_cont', 0.25), 4) as iqr, round(list_aggregate({_LIST}, 'quantile_cont', 0.25), 4) as q, round(list_aggregate({_LIST}, 'quantile_cont', 0.9), 4) as p, round(list_avg({_LIST}), 4) as t, list_position({_LIST}, list_min({_LIST}))::double as lo, list_position({_LIST}, list_max({_LIST}))::double as hi, list_min({_LIST}) as near, round(list_max({_LIST}), 4) as far")
_mutate("row_texts", ["u=unique($l_returnflag,$l_linestatus,$l_returnflag)", "c=collapse($l_returnflag,$l_linestatus)", "n=countunique($l_returnflag,$l_linestatus)", "m=mode($l_returnflag,$l_linestatus,$l_linestatus)", "a=antimode($l_returnflag,$l_linestatus,$l_linestatus)", "f=first($l_returnflag,$l_linestatus)", "l=last($l_returnflag,$l_linestatus)", "k=count($l_returnflag,$l_linestatus)", "h=entropy($l_returnflag,$l_linestatus)"], "u:h",
        "case when l_returnflag = l_linestatus then l_returnflag else l_returnflag || ',' || l_linestatus end as u, l_returnflag || ',' || l_linestatus as c, case when l_returnflag = l_linestatus then 1.0 else 2.0 end::double as n, l_linestatus as m, l_returnflag as a, l_returnflag as f, l_linestatus as l, 2.0::double as k, case when l_returnflag = l_linestatus then 0.0 else 1.0 end::double as h")
query("mutate_substitute", "select p_partkey, regexp_replace(p_brand, '([A-Za-z]+)#(\\d)', '\\2-\\1', 'g') as b, regexp_replace(p_type, '[AEIOU]', '_', 'g') as p_type, p_name from part",
      lambda t: cut(mutate(t("part"), 'b=sub($p_brand,"(?P<word>[A-Za-z]+)#([0-9])","$2-${word}")', "s/p_type/[AEIOU]/_/"), "p_partkey,b,p_type,p_name"))
query("mutate_overwrite", "select n_nationkey::double * 2 as n_nationkey, n_name, n_regionkey from nation", lambda t: mutate(t("nation"), "n_nationkey=$n_nationkey * 2", overwrite=True))
query("mutate_appended", 'select n_nationkey, n_name, n_regionkey, n_regionkey::double + 1 as "n_regionkey#2" from nation', lambda t: mutate(t("nation"), "n_regionkey=$n_regionkey + 1"))

query("mutate_minus_in_name", 'select o_orderkey, round(o_totalprice * 2 - 1, 4) as x from orders',
      lambda t: cut(mutate(t("orders", columns=["o_orderkey", F.col("o_totalprice").alias("o-price")]), "x=$o-price*2 - 1"), "o_orderkey,x"))
query("mutate_other_letters", 'select p_partkey, p_size * 1.0::double as "Maß" from part',
      lambda t: cut(mutate(t("part", columns=["p_partkey", F.col("p_size").alias("größe")]), "Maß=$größe * 1"), "p_partkey,Maß"))
query("mutate_list_as_text", "select o_orderkey, o_orderstatus || chr(9) || o_orderpriority as both from orders",
      lambda t: cut(mutate(t("orders"), "both=$o_orderstatus,$o_orderpriority"), "o_orderkey,both"))
query("mutate_without_header", 'select p_partkey as col1, p_size as col2, p_partkey + p_size::double as col3 from part',
      lambda t: mutate(Table.of(t("part", columns=["p_partkey", "p_size"]).to_df().toDF("col1", "col2"), ["col1"]).headless(), "$1 + $-1"))

# ---------------------------------------------------------------- summarize

_G = "l_returnflag,l_linestatus"


def _summary(name: str, stats: list[str], sql: str, group: str = _G, source: str = "lineitem", order=None, digits: int = 4) -> None:
    g = f"{group}, " if group else ""
    having = "" if group else " having count(*) > 0"
    query(f"summarize_{name}", f"select {g}{sql} from {source}" + (f" group by {group}" if group else "") + having, lambda t: summarize(t(source, order or (LINE_KEY if source == "lineitem" else None)), stats, group or None), digits)


_summary("moments", ["l_quantity=sum,mean,count,sd,var,min,max", "l_extendedprice=sum,avg"],
         "sum(l_quantity) as l_quantity_sum, round(avg(l_quantity), 4) as l_quantity_mean, count(*)::double as l_quantity_count, round(stddev_pop(l_quantity), 4) as l_quantity_sd, round(var_pop(l_quantity), 4) as l_quantity_var, min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max, round(sum(l_extendedprice), 4) as l_extendedprice_sum, round(avg(l_extendedprice), 4) as l_extendedprice_mean")
_summary("global", ["l_quantity:l_tax=mean"], "round(avg(l_quantity), 4) as l_quantity_mean, round(avg(l_extendedprice), 4) as l_extendedprice_mean, round(avg(l_discount), 4) as l_discount_mean, round(avg(l_tax), 4) as l_tax_mean", group="")
_summary("ranks", ["l_extendedprice=median,q1,q0.9,p99,iqr", "l_quantity=q3"],
         "round(median(l_extendedprice), 4) as l_extendedprice_median, round(quantile_cont(l_extendedprice, 0.25), 4) as l_extendedprice_q1, round(quantile_cont(l_extendedprice, 0.9), 4) as \"l_extendedprice_q0_9\", round(quantile_cont(l_extendedprice, 0.99), 4) as l_extendedprice_p99, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as l_extendedprice_iqr, quantile_cont(l_quantity, 0.75) as l_quantity_q3")
query("summarize_trimmean", """
with r as (select l_returnflag, l_linestatus, l_quantity as v, row_number() over (partition by l_returnflag, l_linestatus order by l_quantity) as k, count(*) over (partition by l_returnflag, l_linestatus) as n from lineitem)
select l_returnflag, l_linestatus, round(avg(v), 4) as l_quantity_trimmean from r where k > floor(n * 0.1) and k <= n - floor(n * 0.1) group by 1, 2""",
      lambda t: summarize(t("lineitem"), "l_quantity=trimmean", _G))
_summary("frequencies", ["o_orderstatus=countunique,entropy,mode,antimode,unique"], """
(select count(distinct o_orderstatus)::double from orders x where x.o_orderpriority = orders.o_orderpriority) as o_orderstatus_countunique,
round(entropy(o_orderstatus), 4) as o_orderstatus_entropy,
(select o_orderstatus from orders x where x.o_orderpriority = orders.o_orderpriority group by 1 order by count(*) desc, min(o_orderkey) limit 1) as o_orderstatus_mode,
(select o_orderstatus from orders x where x.o_orderpriority = orders.o_orderpriority group by 1 order by count(*), min(o_orderkey) limit 1) as o_orderstatus_antimode,
(select string_agg(s, ',' order by k) from (select o_orderstatus as s, min(o_orderkey) as k from orders x where x.o_orderpriority = orders.o_orderpriority group by 1)) as o_orderstatus_unique""", group="o_orderpriority", source="orders", order=["o_orderkey"])
query("summarize_ends", """
with r as (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as k from orders)
select o_orderpriority, f.s as o_orderstatus_first, l.s as o_orderstatus_last, lo as o_totalprice_absmin, hi as o_totalprice_absmax, a as o_totalprice_argmin, b as o_totalprice_argmax from (
select o_orderpriority, {'s': arg_min(o_orderstatus, k)} as f, {'s': arg_max(o_orderstatus, k)} as l, round(min(o_totalprice), 4) as lo, round(max(o_totalprice), 4) as hi,
  arg_min(k, (o_totalprice, k))::double as a, arg_max(k, (o_totalprice, -k))::double as b from r group by 1)""",
      lambda t: summarize(t("orders", ["o_orderkey"]), ["o_orderstatus=first,last", "o_totalprice=absmin,absmax,argmin,argmax"], "o_orderpriority"))
_summary("collapse", ["n_name=collapse,distinct"], "string_agg(n_name, ',' order by n_nationkey) as n_name_collapse, count(distinct n_name)::double as n_name_distinct", group="n_regionkey", source="nation", order=["n_nationkey"])
query("summarize_product", "select l_orderkey, round(log10(product(l_quantity)), 4) as magnitude from lineitem group by 1",
      lambda t: cut(mutate(summarize(t("lineitem", LINE_KEY), "l_quantity=prod", "l_orderkey"), "magnitude=log10($l_quantity_prod)"), "l_orderkey,magnitude"))
_summary("sample_free_ranges", ["l_tax:l_quantity=max"], "max(l_tax) as l_tax_max, max(l_discount) as l_discount_max, round(max(l_extendedprice), 4) as l_extendedprice_max, max(l_quantity) as l_quantity_max", group="l_linenumber")
query("summarize_random", None, lambda t: summarize(t("orders", ["o_orderkey"]), "o_orderstatus=rand", "o_orderpriority", seed=7))

# ---------------------------------------------------------------- join

query("join_inner", "select r_regionkey, r_name, n_nationkey, n_name from region join nation on r_regionkey = n_regionkey", lambda t: join([t("region"), t("nation")], "r_regionkey;n_regionkey"))
_SIDES = ["sample_id", "rec_id"]
_A, _B, _C = (f"(select coalesce(sample_id, '') as k, rec_id, load_id from {t})" for t in ("samples", "qc", "cytokines"))
query("join_full", f'select coalesce(a.k, b.k) as sample_id, a.rec_id, b.rec_id as "rec_id#2" from {_A} a full join {_B} b on a.k = b.k',
      lambda t: join([t("samples", ["rec_id"], columns=_SIDES), t("qc", ["rec_id"], columns=_SIDES)], "sample_id", keep="0"))
query("join_left", f'select a.k as sample_id, a.rec_id, b.rec_id as "rec_id#2" from {_A} a left join {_B} b on a.k = b.k',
      lambda t: join([t("samples", ["rec_id"]), t("qc", ["rec_id"])], "sample_id", keep="1", select="rec_id;rec_id"))
query("join_right", f'select b.k as sample_id, a.rec_id, b.rec_id as "rec_id#2" from {_A} a right join {_B} b on a.k = b.k',
      lambda t: join([t("samples", ["rec_id"]), t("qc", ["rec_id"])], "sample_id", keep="2", select="rec_id;rec_id"))
query("join_three", """
select n_regionkey, n_name, r_name, c_name from nation join region on n_regionkey = r_regionkey join customer on n_regionkey = c_nationkey""",
      lambda t: join([t("nation"), t("region"), t("customer")], "n_regionkey;r_regionkey;c_nationkey", select="n_name;r_name;c_name"))
query("join_keep_some", f"""
with keys as (select k from {_A} union select k from {_C})
select keys.k as sample_id, a.rec_id, b.rec_id as "rec_id#2", c.rec_id as "rec_id#3" from keys left join {_A} a using (k) left join {_B} b using (k) left join {_C} c using (k)""",
      lambda t: join([t(n, ["rec_id"], columns=_SIDES) for n in ("samples", "qc", "cytokines")], "sample_id", keep="1,3"))
query("join_two_keys", "select a.l_orderkey, a.l_linenumber, a.l_quantity, a.l_tax, b.l_quantity as \"l_quantity#2\" from lineitem a join lineitem b using (l_orderkey, l_linenumber)",
      lambda t: join([t("lineitem"), t("lineitem")], "l_orderkey,l_linenumber", select="l_quantity,l_tax;l_quantity"))
query("join_fill", f"select a.k as sample_id, a.load_id, case when b.k is null then 'none' else b.load_id end as \"load_id#2\" from {_A} a left join {_B} b on a.k = b.k",
      lambda t: join([t("samples", ["rec_id"]), t("qc", ["rec_id"])], "sample_id", keep="1", select="load_id;load_id", fill="none"))
query("join_merge", "select o_orderkey, o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey",
      lambda t: join([t("orders"), t("lineitem")], "o_orderkey;l_orderkey", select="o_custkey;l_partkey", merge=True))
query("join_text_keys", "select n_name, r_name from nation join region on n_regionkey::varchar = r_regionkey::varchar",
      lambda t: cut(join([t("nation", columns=["n_name", F.col("n_regionkey").cast("string").alias("k")]), t("region", columns=[F.col("r_regionkey").cast("string").alias("k"), "r_name"])], "k"), "n_name,r_name"))

query("join_order", "select r_regionkey, r_name, n_nationkey, n_name from (select *, row_number() over (order by r_regionkey, n_nationkey) as k from region join nation on r_regionkey = n_regionkey) where k between 4 and 17",
      lambda t: take(join([t("region", ["r_regionkey"]), t("nation", ["n_nationkey"])], "r_regionkey;n_regionkey"), "4:17"))

# ---------------------------------------------------------------- sort, slice


query("sort_top", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25", lambda t: take(sort(cut(t("customer", ["c_custkey"]), "c_custkey,c_acctbal"), "c_acctbal:nr"), ":25"))
query("sort_texts", "select c_mktsegment, c_name from customer order by c_mktsegment desc, c_name limit 40", lambda t: take(sort(cut(t("customer", ["c_custkey"]), "c_mktsegment,c_name"), "c_mktsegment:r", "c_name"), ":40"))
query("sort_from_end", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 10", lambda t: take(sort(cut(t("orders", ["o_orderkey"]), "o_orderkey,o_totalprice"), "o_totalprice:n"), "-10:"))
query("sort_stable", "select n_nationkey, n_regionkey from nation order by n_regionkey, n_nationkey limit 7", lambda t: take(sort(cut(t("nation", ["n_nationkey"]), "n_nationkey,n_regionkey"), "n_regionkey:num"), "1:7"))
_SORTED = "select {}, l_quantity from (select *, row_number() over (order by l_quantity{} , {}) as k, count(*) over () as n from lineitem) where "


def _places(name: str, key: str, spec: str, sql: str, turned: str = "") -> None:
    """Rows by place in a table sorted by another column, wherever they lie after a shuffle."""
    by = ", ".join(LINE_KEY)
    query(name, _SORTED.format(by, turned, by) + sql, lambda t: take(sort(cut(t("lineitem", LINE_KEY), f"{_K},l_quantity"), key), spec))


_places("sort_slice_middle", "l_quantity:n", "20000:20100,300:", "k >= 300")
_places("sort_slice_range", "l_quantity:nr", "30001:30100", "k between 30001 and 30100", " desc")
_places("sort_slice_tail", "l_quantity:n", "-25:", "k > n - 25")
_S = "select o_orderkey, o_totalprice from (select *, row_number() over (order by o_orderkey) as k, count(*) over () as n from orders) where "


def _slice(name: str, spec: str, sql: str) -> None:
    query(f"slice_{name}", _S + sql, lambda t: take(cut(t("orders", ["o_orderkey"]), "o_orderkey,o_totalprice"), spec))


_slice("places", "3,1,3,999999999", "k in (1, 3)")
_slice("range", "10:20,15:30", "k between 10 and 30")
_slice("open", "14000:", "k >= 14000")
_slice("head", ":100", "k <= 100")
_slice("tail", "-5:", "k > n - 5")
_slice("all_but_last", ":-2", "k < n")
_slice("mixed", "2,-3:-2", "k = 2 or k in (n - 2, n - 1)")

# ---------------------------------------------------------------- melt, pivot, info

query("melt_all", "unpivot (select c_custkey, c_name, c_mktsegment from customer) on c_name, c_mktsegment into name variable value value",
      lambda t: melt(t("customer", columns=["c_custkey", "c_name", "c_mktsegment"]), "c_custkey"))
query("melt_chosen", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, u.k as measure, round(u.v, 4) as amount from lineitem, lateral (select unnest(['l_quantity', 'l_tax']) as k, unnest([l_quantity, l_tax]) as v) u",
      lambda t: melt(t("lineitem"), _K, "l_quantity,l_tax", variable="measure", value="amount"))
query("melt_fill", "select n_nationkey::varchar as n_nationkey, u.k as variable, u.v as value from nation, lateral (select unnest(['n_name', 'n_regionkey']) as k, unnest([n_name, n_regionkey::varchar]) as v) u",
      lambda t: melt(t("nation"), "n_nationkey", "n_name,n_regionkey", fill="-"))
query("pivot_counts", "select o_orderpriority, count(*) filter (o_orderstatus = 'F')::double as \"F\", count(*) filter (o_orderstatus = 'O')::double as \"O\", nullif(count(*) filter (o_orderstatus = 'P'), 0)::double as \"P\" from orders group by 1",
      lambda t: cut(pivot(summarize(t("orders", ["o_orderkey"]), "o_orderkey=count", "o_orderpriority,o_orderstatus"), "o_orderpriority", "o_orderstatus", "o_orderkey_count"), "o_orderpriority,F,O,P"))
query("pivot_fill", "select l_linenumber, coalesce(max(l_quantity) filter (l_returnflag = 'A')::bigint::varchar, 'none') as \"A\", coalesce(max(l_quantity) filter (l_returnflag = 'N')::bigint::varchar, 'none') as \"N\", coalesce(max(l_quantity) filter (l_returnflag = 'R')::bigint::varchar, 'none') as \"R\" from lineitem group by 1",
      lambda t: cut(pivot(_whole(summarize(t("lineitem", LINE_KEY), "l_quantity=max", "l_linenumber,l_returnflag")), "l_linenumber", "l_returnflag", "l_quantity_max", fill="none"), "l_linenumber,A,N,R"))


def _whole(t: Table) -> Table:
    return t.with_columns([(n, t.col(i).cast("bigint") if t.kind(i).simpleString() == "double" else t.col(i)) for i, n in enumerate(t.names)])


query("info_customer", """
select * from (values (1, 'c_custkey', 'num'), (2, 'c_name', 'str'), (3, 'c_nationkey', 'num'), (4, 'c_acctbal', 'num'), (5, 'c_mktsegment', 'str')) v(index, name, type), (select count(*) as rows from customer)""",
      lambda t: cut(info(t("customer", ["c_custkey"])), "index,name,type,rows"))
query("info_heads", """
select index, name, type, '[' || h || ']' as first2 from (values (1, 'n_nationkey', 'num'), (2, 'n_name', 'str'), (3, 'n_regionkey', 'num')) v(index, name, type),
lateral (select string_agg(case v.index when 1 then n_nationkey::varchar when 2 then n_name else n_regionkey::varchar end, ', ' order by n_nationkey) as h from nation where n_nationkey < 2)""",
      lambda t: cut(info(t("nation", ["n_nationkey"]), 2), "index,name,type,first2"))

# ---------------------------------------------------------------- a pipeline

query("pipeline_flagship", """
select c_mktsegment, o_orderpriority, count(*)::double as net_count, round(sum(o_totalprice * 0.9 + 1), 4) as net_sum, round(avg(o_totalprice * 0.9 + 1), 4) as net_mean
from orders join customer on o_custkey = c_custkey where c_acctbal > 0 and o_totalprice >= 1000 group by 1, 2""",
      lambda t: summarize(mutate(keep(join([t("orders"), t("customer")], "o_custkey;c_custkey"), "$c_acctbal > 0 & $o_totalprice >= 1000"), "net=$o_totalprice * 0.9 + 1"), "net=count,sum,mean", "c_mktsegment,o_orderpriority"))


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}

