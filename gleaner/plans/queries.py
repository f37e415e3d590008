"""The engine's queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import clean_name, shortened
from gleaner.operators import detectors as D
from gleaner.operators import histogram as H
from gleaner.operators import scatter as S
from gleaner.operators import summary as A
from gleaner.operators import wranglers as W
from gleaner.plans import payload as P
from gleaner.plans.session import Session
from gleaner.sources import ID, head, id_range, ingest, load, read_csv, shared_folder, slice_both, with_id
from gleaner.streaming import fit_limits
from gleaner.streaming import stream_errors as streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Events made dirty by rules; first match wins.  The same text serves both engines, but for the name of text.
EV_CASES = """event_id as "ID", case when event_id % 53 = 0 then null when event_id % 97 = 0 then 'undefined' when event_id % 89 = 0 then 'n/a' else cast(user_id as {text}) end as user_txt,
case when event_id % 71 = 0 then 'null' else event_type end as kind, case when event_id % 4999 = 7 then 'rare' else event_type end as tag, value, cast(null as {text}) as blank"""
ERR = """errs as (
select "ID" as row_id, 'user_txt' as column_id, 'missing' as error_type from ev where user_txt is null or user_txt in ('null', 'undefined')
union all select "ID", 'kind', 'missing' from ev where kind is null or kind in ('null', 'undefined')
union all select "ID", 'blank', 'missing' from ev
union all select "ID", 'user_txt', 'mismatch' from ev where not regexp_full_match(user_txt, '[0-9]+([.][0-9]+)?')
union all select "ID", 'value', 'anomaly' from ev, (select avg(value) m, stddev_samp(value) s from ev) where abs(value - m) > 2 * s
union all select "ID", 'user_txt', 'anomaly' from (select "ID", try_cast(user_txt as double) v from ev), (select avg(try_cast(user_txt as double)) m, stddev_samp(try_cast(user_txt as double)) s from ev) where abs(v - m) > 2 * s
union all select "ID", 'tag', 'incomplete' from ev join (select tag from ev group by tag having count(*) < 3) using (tag)
union all select "ID", 'kind', 'incomplete' from ev join (select kind from ev group by kind having count(*) < 3) using (kind))"""
EV = f"with ev as (select {EV_CASES.format(text='varchar')} from events), "
EVE = EV + ERR + " "


def ev(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet")
    return df.selectExpr(*_split(EV_CASES.format(text="string").replace('"ID"', "ID")))


def _split(text: str) -> list[str]:
    """The expressions of a select list at the outer level."""
    out, depth, quote = [""], 0, False
    for ch in text:
        quote ^= ch == "'"
        depth += 0 if quote else {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and not depth and not quote:
            out.append("")
        else:
            out[-1] += ch
    return out


def table(name: str, key: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, d: str) -> DataFrame:
        df = spark.read.parquet(f"{d}/{name}.parquet")
        return df if key is None else df.select(F.col(key).alias(ID), *(c for c in df.columns if c != key))

    return read


orders, part, customer, lineitem = table("orders", "o_orderkey"), table("part", "p_partkey"), table("customer", "c_custkey"), table("lineitem")
events = table("events", "event_id")


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def errors(s: SparkSession, d: str) -> DataFrame:
    return D.run_detectors(ev(s, d))


def bins(v: str, n: int, source: str, extra: str = "") -> str:
    """SQL of right-closed equal bins of column v."""
    return f"""(select t.*, {v} as v, greatest(0, least({n} - 1, len([i for i in range(1, {n}) if mn + i * (mx - mn) / {n} < {v}]))) as b from {source} t, (select min({v}) mn, max({v}) mx from {source}) where {v} is not null {extra})"""


# sources


@query('select o_orderkey as "ID", o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders')
def assign_id_preserve(s, d):
    df = table("orders")(s, d).withColumnRenamed("o_orderkey", ID)
    return with_id(df).select(ID, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query('select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as "ID", l_orderkey, l_linenumber, l_partkey from lineitem')
def assign_id_generate(s, d):
    return with_id(lineitem(s, d), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select(ID, "l_orderkey", "l_linenumber", "l_partkey")


@query('select row_number() over (order by l_orderkey, l_linenumber) as "ID", l_orderkey as "Original_ID", l_linenumber from lineitem')
def assign_id_replace(s, d):
    df = lineitem(s, d).select(F.col("l_orderkey").alias(ID), "l_linenumber")
    return with_id(df, [ID, "l_linenumber"])


@query("select o_orderkey as \"ID\", o_totalprice from orders where o_orderkey between 100 and 5000")
def id_range_slice(s, d):
    return id_range(orders(s, d), 100, 5000).select(ID, "o_totalprice")


@query(EVE + 'select row_id, column_id, error_type from errs where row_id between 0 and 200')
def error_range_slice(s, d):
    df = ev(s, d)
    return slice_both(df, D.run_detectors(df), 0, 200)[1]


@query('select o_orderkey as "ID", o_orderstatus from orders order by o_orderkey limit 200')
def sample_head(s, d):
    return head(orders(s, d), 200).select(ID, "o_orderstatus")


_name = "lower(case when regexp_matches({0}, '^[a-zA-Z]') then {0} else 'table' || {0} end)"
_base = "regexp_replace(regexp_replace({0}, '\\.csv$', ''), '[^a-zA-Z0-9_]', '_', 'g')"


@query(f"select url, {_name.format(_base.format('url'))} as name, {_name.format(_base.format('(page_id || $$-x.csv$$)'))} as other from pages")
def table_name_clean(s, d):
    return table("pages")(s, d).select("url", clean_name(F.col("url")).alias("name"), clean_name(F.concat(F.col("page_id").cast("string"), F.lit("-x.csv"))).alias("other"))


# detectors


def _errors(kind: str):
    return EVE + f"select row_id, column_id, error_type from errs where error_type = '{kind}'"


@query(_errors("missing"))
def detect_missing(s, d):
    return D.missing_value(ev(s, d))


@query(_errors("mismatch"))
def detect_mismatch(s, d):
    return D.datatype_mismatch(ev(s, d))


@query(_errors("anomaly"))
def detect_anomaly(s, d):
    return D.anomaly(ev(s, d))


@query("select doc_id as row_id, 'n_chars' as column_id, 'anomaly' as error_type from documents, (select avg(n_chars) m, stddev_samp(n_chars) s from documents) where abs(n_chars - m) > 2 * s")
def detect_anomaly_docs(s, d):
    return D.anomaly(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias(ID), "n_chars"))


@query(_errors("incomplete"))
def detect_incomplete(s, d):
    return D.incomplete(ev(s, d))


@query("select c_custkey as row_id, 'c_name' as column_id, 'incomplete' as error_type from customer join (select c_name from customer group by c_name having count(*) < 3) using (c_name)")
def detect_incomplete_names(s, d):
    return D.incomplete(customer(s, d), ["c_name"])


@query(EVE + "select row_id, column_id, error_type from errs")
def detect_all(s, d):
    return errors(s, d)


@query(EV.rstrip(", ") + """ select "ID" as row_id, 'user_txt' as column_id, 'missing' as error_type from ev where user_txt is null or lower(trim(user_txt)) in ('', 'null', 'undefined')
union all select "ID", 'kind', 'missing' from ev where kind is null or lower(trim(kind)) in ('', 'null', 'undefined')""")
def detect_missing_client(s, d):
    return D.missing_value(ev(s, d), ["user_txt", "kind"], client=True)


@query(EV.rstrip(", ") + """ select "ID" as row_id, 'value' as column_id, 'anomaly' as error_type from ev, (select avg(value) m, stddev_samp(value) s from ev) where abs(value - m) > 2 * s""")
def detect_anomaly_client(s, d):
    return D.anomaly(ev(s, d), client=True)


@query(EV.rstrip(", ") + """ select "ID" as row_id, 'tag' as column_id, 'incomplete' as error_type from ev join (select trim(tag) t from ev group by 1 having count(*) < 3) on trim(tag) = t""")
def detect_incomplete_client(s, d):
    return D.incomplete(ev(s, d), ["tag"], client=True)


@query(EV.rstrip(", ") + """ select "ID" as row_id, 'user_txt' as column_id, 'mismatch' as error_type from ev where regexp_full_match(user_txt, '[0-9]+([.][0-9]+)?')""")
def detect_mismatch_client(s, d):
    return D.datatype_mismatch(ev(s, d), ["user_txt", "kind"], client=True)


@query(EVE + "select column_id, row_id, string_agg(error_type, ',' order by error_type) as errors from errs where row_id between 1 and 400 group by column_id, row_id")
def error_dict(s, d):
    return D.error_dict(errors(s, d), 1, 400).select("column_id", "row_id", F.array_join("errors", ",").alias("errors"))


@query(EVE + "select row_id, column_id, error_type from errs where column_id in ('kind', 'tag')")
def errors_of_columns(s, d):
    return D.errors_of(errors(s, d), ["kind", "tag"])


# summaries

_DIST = EVE + ", dist as (select error_type, column_id, count(*) / (select count(*) from ev)::double as fraction from errs group by all) "


@query(_DIST + "select error_type, column_id, fraction from dist")
def error_distribution_long(s, d):
    df = ev(s, d)
    return A.error_distribution(D.run_detectors(df), df)


@query(_DIST + "select error_type, sum(case when column_id = 'user_txt' then fraction else 0.0::double end) as user_txt, sum(case when column_id = 'kind' then fraction else 0.0::double end) as kind, sum(case when column_id = 'value' then fraction else 0.0::double end) as value from dist group by error_type")
def error_distribution_wide(s, d):
    df = ev(s, d)
    return A.error_distribution_wide(D.run_detectors(df), df, ["user_txt", "kind", "value"])


@query(_DIST + "select column_id, error_type, fraction from dist")
def error_maps(s, d):
    df = ev(s, d)
    return A.error_maps(D.run_detectors(df), df).select("column_id", F.explode("errors").alias("error_type", "fraction"))


@query(EVE + "select row_id, count(distinct column_id) as cells from errs group by row_id")
def row_error_count(s, d):
    return A.row_errors(errors(s, d))


@query(EVE + 'select "ID", coalesce(n, 0) as cells from ev left join (select row_id, count(distinct column_id) n from errs group by row_id) on row_id = "ID" order by cells desc, "ID" limit 10')
def dirty_rows_top10(s, d):
    df = ev(s, d)
    return A.dirty_rows(df, D.run_detectors(df))


@query(EVE + "select row_id, column_id, arg_min(error_type, case error_type when 'anomaly' then 0 when 'mismatch' then 1 when 'missing' then 2 when 'incomplete' then 3 else 4 end) as error_type from errs group by row_id, column_id")
def cell_priority(s, d):
    return A.cell_priority(errors(s, d))


_KIND = " union all ".join(f"select '{c}' as column_id, case when count({c}) filter (regexp_full_match({c}, '[0-9]+([.][0-9]+)?')) > count({c}) / 2 then 'numeric' else 'categorical' end as kind from ev" for c in ("user_txt", "kind", "tag", "blank"))


@query(EV.rstrip(", ") + f" {_KIND} union all select 'value', case when count(value) > 0 then 'numeric' else 'categorical' end from ev")
def column_kind(s, d):
    df = ev(s, d)
    return s.createDataFrame([*H.column_kinds(df, D.value_columns(df)).items()], "column_id string, kind string")


@query("select 'o_totalprice' as column_id, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as min, max(o_totalprice) as max from orders union all select 'o_custkey', round(avg(o_custkey), 4), min(o_custkey)::double, max(o_custkey)::double from orders")
def attribute_stats_numeric(s, d):
    return A.numeric_stats(orders(s, d), ["o_totalprice", "o_custkey"]).withColumn("mean", F.round("mean", 4))


@query("with a as (select p_type v, count(*) n from part group by 1), b as (select p_brand v, count(*) n from part group by 1) select 'p_type' as column_id, (select count(*) from a) as distinct_values, min(v) as mode from a where n = (select max(n) from a) union all select 'p_brand', (select count(*) from b), min(v) from b where n = (select max(n) from b)")
def attribute_stats_categorical(s, d):
    return A.categorical_stats(part(s, d), ["p_type", "p_brand"])


@query(EV.rstrip(", ") + ", a as (select coalesce(user_txt, 'N/A') v, count(*) n from ev group by 1) select 'user_txt' as column_id, (select count(*) from a) as distinct_values, min(v) as mode from a where n = (select max(n) from a)")
def attribute_stats_nulls(s, d):
    return A.categorical_stats(ev(s, d), ["user_txt"])


_RANK = _DIST + ", r as (select c as column_id, coalesce(sum(fraction), 0.0) as total, coalesce(sum(case when error_type = 'missing' then fraction else 0.0::double end), 0.0) as share from (values ('user_txt'), ('kind'), ('tag'), ('value'), ('blank')) t(c) left join dist on c = column_id group by c) "
_COLUMNS = ["user_txt", "kind", "tag", "value", "blank"]


def _ranked(s, d, by: str) -> DataFrame:
    df = ev(s, d)
    return A.ranking(D.run_detectors(df), df, _COLUMNS, by).select("column_id", F.round("total", 9).alias("total"), F.col("rank").cast("long").alias("rank"))


@query(_RANK + "select column_id, round(total, 9) as total, row_number() over (order by total desc, column_id) as rank from r")
def attribute_ranking_total(s, d):
    return _ranked(s, d, "total")


@query(_RANK + "select column_id, round(total, 9) as total, row_number() over (order by share desc, total desc, column_id) as rank from r")
def attribute_ranking_type(s, d):
    return _ranked(s, d, "missing")


@query(_RANK + "select column_id, round(total, 9) as total, row_number() over (order by total, column_id) as rank from r")
def attribute_ranking_clean(s, d):
    return _ranked(s, d, "none")


@query(_RANK + "select column_id from r order by total desc, column_id limit 3")
def default_attributes(s, d):
    df = ev(s, d)
    return A.default_attributes(D.run_detectors(df), df, _COLUMNS)


@query("select p_size::varchar as value, row_number() over (order by p_size) as place from (select distinct p_size from part)")
def category_order(s, d):
    return A.category_order(part(s, d), "p_size").select("value", F.col("place").cast("long").alias("place"))


# histograms


@query(f"select i as x_bin, count(b) as items from range(10) g(i) left join {bins('value', 10, 'events')} on b = i group by i")
def hist1d_numeric(s, d):
    df = events(s, d)
    return H.histogram(df, _none(s), "value").select("x_bin", "items")


def _none(s) -> DataFrame:
    return s.createDataFrame([], D.ERRORS)


@query("select o_orderpriority as x, count(*) as items from orders group by 1")
def hist1d_categorical(s, d):
    return H.histogram(orders(s, d), _none(s), "o_orderpriority").select("x", "items")


@query("select 'null' as x, count(*) as items from events")
def hist1d_null_column(s, d):
    return H.histogram(ev(s, d), _none(s), "blank").select("x", "items")


@query(f"select g.i as x_bin, h.i as y_bin, count(q.b) as items from range(10) g(i) cross join range(10) h(i) left join (select a.b, c.b as b2 from {bins('l_quantity', 10, 'lineitem')} a join {bins('l_extendedprice', 10, 'lineitem')} c on a.l_orderkey = c.l_orderkey and a.l_linenumber = c.l_linenumber and a.l_partkey = c.l_partkey and a.l_suppkey = c.l_suppkey) q on q.b = g.i and q.b2 = h.i group by 1, 2")
def hist2d_num_num(s, d):
    df = lineitem(s, d).withColumn(ID, F.col("l_orderkey"))  # counts need no unique ID
    return H.histogram(df, _none(s), "l_quantity", "l_extendedprice").select("x_bin", "y_bin", "items")


@query(f"select x, i as y_bin, count(b) as items from (select distinct o_orderpriority x from orders) cross join range(5) g(i) left join {bins('o_totalprice', 5, 'orders')} on b = i and x = o_orderpriority group by 1, 2")
def hist2d_cat_num(s, d):
    return H.histogram(orders(s, d), _none(s), "o_orderpriority", "o_totalprice", m=5).select("x", "y_bin", "items")


@query(EV.rstrip(", ") + " select x, y, count(tag) as items from (select distinct kind x from ev) cross join (select distinct tag y from ev) left join ev on kind = x and tag = y group by 1, 2")
def hist2d_cat_cat(s, d):
    return H.histogram(ev(s, d), _none(s), "kind", "tag").select("x", "y", "items")


@query(EVE + """select kind as x, error_type, count(*) as n from errs join ev on row_id = "ID" where column_id = 'kind' group by 1, 2""")
def hist1d_errors(s, d):
    df = ev(s, d)
    return H.histogram_errors(H.histogram(df, D.run_detectors(df), "kind")).select("x", "error_type", "n")


@query(EVE + f"""select b as x_bin, kind as y, error_type, count(*) as n from errs join {bins('value', 10, 'ev')} q on row_id = q."ID" where column_id in ('kind', 'value') group by 1, 2, 3""")
def hist2d_errors(s, d):
    df = ev(s, d)
    return H.histogram_errors(H.histogram(df, D.run_detectors(df), "value", "kind")).select("x_bin", "y", "error_type", "n")


@query(EVE + f""", q as (select "ID", b from {bins('value', 10, 'ev')}), c as (select b, count(*) as items from q group by 1),
e as (select b, error_type as segment, count(*) as n from errs join q on row_id = q."ID" where column_id = 'value' group by 1, 2),
a as (select b, segment, n, 0 as last from e union all select c.b, 'none', items - coalesce(t, 0), 1 from c left join (select b, sum(n) t from e group by 1) using (b) where items > coalesce(t, 0))
select b as x_bin, segment, cast(coalesce(sum(n) over (partition by b order by last, segment rows between unbounded preceding and 1 preceding), 0) as bigint) as bottom, cast(sum(n) over (partition by b order by last, segment rows unbounded preceding) as bigint) as top from a""")
def bar_segments(s, d):
    df = ev(s, d)
    return H.bar_segments(H.histogram(df, D.run_detectors(df), "value")).select("x_bin", "segment", "bottom", "top")


@query("select i as code, cast(trunc(round(mn + i * (mx - mn) / 10 - case when i = 0 then 0.001 * (mx - mn) else 0 end, 3)) as bigint) as x0, cast(trunc(round(mn + (i + 1) * (mx - mn) / 10, 3)) as bigint) as x1 from range(10) g(i), (select min(o_totalprice) mn, max(o_totalprice) mx from orders)")
def scale_numeric(s, d):
    return H.scale(orders(s, d), "o_totalprice")


@query(EV.rstrip(", ") + " select distinct kind as label from ev")
def scale_categorical(s, d):
    return H.scale(ev(s, d), "kind")


@query(EV.rstrip(", ") + " select cast(trunc(min(value)) as bigint) as low, cast(trunc(max(value)) as bigint) + 1 as high from ev")
def scatter_scale_numeric(s, d):
    return S.scatter_scale(ev(s, d), "value")


@query(EV.rstrip(", ") + " select distinct coalesce(kind, 'null') as label from ev")
def scatter_scale_categorical(s, d):
    return S.scatter_scale(ev(s, d), "kind")


@query(EV.rstrip(", ") + """, q as (select user_txt, case when regexp_full_match(user_txt, '[0-9]+') then cast(user_txt as double) end v from ev where user_txt is not null), m as (select min(v) mn, max(v) mx from q)
select case when v is null then 'categorical' else 'numeric' end as class, case when v is null then -1 else len([i for i in range(1, 10) if mn + i * (mx - mn) / 10 < v]) end as x_bin, case when v is null then user_txt end as x, count(*) as items from q, m group by 1, 2, 3""")
def hist1d_mixed(s, d):
    return H.mixed_histogram(ev(s, d), "user_txt").withColumn("x_bin", F.coalesce("x_bin", F.lit(-1)))


_SAMPLE = EVE + """, own as (select distinct row_id from errs where column_id in ('value', 'kind')),
a as (select "ID", true as has_error from ev where "ID" in (select row_id from own) order by md5("ID" || '0'), "ID" limit 30),
b as (select "ID", false as has_error from ev where "ID" not in (select row_id from own) order by md5("ID" || '0'), "ID" limit (select greatest(0, 100 - count(*)) from a)), """


@query(_SAMPLE.rstrip(", ") + " select * from a union all select * from b")
def scatter_sample(s, d):
    df = ev(s, d)
    return S.sample(df, D.run_detectors(df), "value", "kind")


@query(_SAMPLE + """c as (select "ID" from a union all select "ID" from b) select c."ID", 'categorical' as "xType", 'categorical' as "yType", coalesce(kind, 'null') as x, coalesce(tag, 'null') as y, coalesce((select string_agg(error_type, ',' order by error_type) from errs where row_id = c."ID" and column_id in ('kind', 'tag')), '') as errors
from ev join (with own2 as (select distinct row_id from errs where column_id in ('kind', 'tag')), a2 as (select "ID" from ev where "ID" in (select row_id from own2) order by md5("ID" || '0'), "ID" limit 30), b2 as (select "ID" from ev where "ID" not in (select row_id from own2) order by md5("ID" || '0'), "ID" limit (select greatest(0, 100 - count(*)) from a2)) select * from a2 union all select * from b2) c on ev."ID" = c."ID" """.replace('c as (select "ID" from a union all select "ID" from b) ', "unused as (select 1) "))
def scatter_entries(s, d):
    df = ev(s, d)
    return S.entries(df, D.run_detectors(df), "kind", "tag").withColumn("errors", F.array_join("errors", ","))


@query("select o_orderpriority as a, o_orderstatus as g, count(*) as n from orders group by 1, 2")
def crosstab_groupby(s, d):
    return H.crosstab(orders(s, d), "o_orderpriority", "o_orderstatus")


@query("select o_orderpriority, nullif(count(*) filter (o_orderstatus = 'F'), 0) as \"F\", nullif(count(*) filter (o_orderstatus = 'O'), 0) as \"O\", nullif(count(*) filter (o_orderstatus = 'P'), 0) as \"P\" from orders group by 1")
def crosstab_wide(s, d):
    return H.crosstab_wide(orders(s, d), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(f"select g.i as x_bin, h.i as y_bin, count(q.b) as n from range(4) g(i) cross join range(3) h(i) left join (select a.b, c.b as b2 from {bins('p_size', 4, 'part')} a join {bins('p_retailprice', 3, 'part')} c using (p_partkey)) q on q.b = g.i and q.b2 = h.i group by 1, 2")
def crosstab_bins(s, d):
    return H.crosstab_bins(part(s, d), "p_size", "p_retailprice", 4, 3).select("x_bin", "y_bin", "n")


# repairs

_EV5 = 'ev."ID", user_txt, kind, tag, value'


@query(EV.rstrip(", ") + f" select {_EV5} from ev where \"ID\" % 7 <> 0")
def wrangle_remove(s, d):
    df = ev(s, d)
    return W.remove_rows(df, df.where("ID % 7 = 0").select(ID)).select(ID, "user_txt", "kind", "tag", "value")


_MEAN = "(select coalesce(round_even(avg(value) filter (value > 0), 1), 0) as m from ev)"


@query(EV.rstrip(", ") + f' select "ID", case when "ID" % 10 = 0 then m else value end as value from ev, {_MEAN}')
def impute_mean(s, d):
    df = ev(s, d)
    return W.impute(df, "value", df.where("ID % 10 = 0").select(ID)).select(ID, "value")


_MODE = '(select kind as m from ev where kind is not null group by kind order by count(*) desc, min("ID") limit 1)'


@query(EV.rstrip(", ") + f' select "ID", case when "ID" % 71 = 0 then m else kind end as kind from ev, {_MODE}')
def impute_mode(s, d):
    df = ev(s, d)
    return W.impute(df, "kind", df.where("ID % 71 = 0").select(ID)).select(ID, "kind")


@query(EV.rstrip(", ") + f" select m as value from {_MEAN}")
def preview_average(s, d):
    return W.average(ev(s, d), "value")


def _without(where: str) -> str:
    return EV.replace("from events)", f"from events where {where})") + ERR + " select row_id, column_id, error_type from errs"


@query(_without("event_id % 7 <> 0"))
def remove_then_detect(s, d):
    df = ev(s, d)
    return D.run_detectors(W.remove_rows(df, df.where("ID % 7 = 0").select(ID)))


_IMPUTED = EV.replace("with ev as", "with ev0 as") + f"""ev as (select "ID", user_txt, case when "ID" % 71 = 0 then m else kind end as kind, tag, value, blank from ev0, {_MODE.replace('from ev ', 'from ev0 ')}), """


@query(_IMPUTED + ERR + " select row_id, column_id, error_type from errs")
def impute_then_detect(s, d):
    df = ev(s, d)
    return D.run_detectors(W.impute(df, "kind", df.where("ID % 71 = 0").select(ID)))


# predicates and groups


@query('select o_orderkey as "ID", o_totalprice from orders where not coalesce(o_totalprice > 100000, false)')
def predicate_fail_numeric(s, d):
    return A.failing(orders(s, d), "o_totalprice", ">", "100000").select(ID, "o_totalprice")


@query(EV.rstrip(", ") + " select \"ID\", kind from ev where not coalesce(kind = 'click', false)")
def predicate_fail_categorical(s, d):
    return A.failing(ev(s, d), "kind", "=", "click").select(ID, "kind")


@query("select o_orderkey as \"ID\", o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def group_filter(s, d):
    return A.group_filter(orders(s, d), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select(ID, "o_orderpriority")


@query('select o_orderkey as "ID", o_totalprice, o_orderstatus from orders')
def attribute_projection(s, d):
    return A.attributes(orders(s, d), ["o_totalprice"], "o_orderstatus")


@query('select o_orderkey as "ID" from orders where o_totalprice > 50000 and o_totalprice < 90000 and o_custkey > 100 and o_custkey < 900')
def brush_select(s, d):
    return S.brush(orders(s, d), "o_totalprice", "o_custkey", (50000, 90000), (100, 900)).select(ID)


@query(f'select o_orderkey as "ID" from {bins("o_totalprice", 10, "orders")} where b in (0, 9)')
def select_bin_rows(s, d):
    chosen = s.createDataFrame([(0,), (9,)], "x_bin long")
    return H.rows_of_bins(orders(s, d), chosen, "o_totalprice").select(ID)


@query("select round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as stdev, median(o_totalprice) as median, (select round(median(abs(o_totalprice - m)), 6) from orders, (select median(o_totalprice) m from orders)) as mad from orders")
def box_stats_overall(s, d):
    return A.box_overall(orders(s, d), "o_totalprice").select(F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"), "median", F.round("mad", 6).alias("mad"))


@query('select o_orderpriority as "group", min(o_totalprice) as min, round(quantile_cont(o_totalprice, 0.25), 6) as q1, round(median(o_totalprice), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as q3, max(o_totalprice) as max, round(avg(o_totalprice), 4) as mean from orders group by 1')
def box_stats_group(s, d):
    return A.box_groups(orders(s, d), "o_totalprice", "o_orderpriority").select("group", "min", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"), F.round("q3", 6).alias("q3"), "max", F.round("mean", 4).alias("mean"))


@query("""with t as (select p_brand, case when p_brand in ('Brand#11', 'Brand#23') then p_size * 100 else p_size end as v from part), m as (select median(v) a from t), mad as (select median(abs(v - a)) b from t, m)
select p_brand as "group", median(v) as median from t group by 1 having abs(median(v) - (select a from m)) > 2 * (select b from mad)""")
def significant_groups(s, d):
    df = part(s, d).withColumn("v", F.when(F.col("p_brand").isin("Brand#11", "Brand#23"), F.col("p_size") * 100).otherwise(F.col("p_size")))
    return A.significant_groups(df, "v", "p_brand")


@query(EV.rstrip(", ") + " select round(avg(v), 6) as mean, min(v) as min, max(v) as max, cast(count(user_txt) - count(v) as bigint) as others, (select user_txt from ev where not regexp_full_match(user_txt, '[0-9]+') group by 1 order by count(*) desc, 1 desc limit 1) as other_mode from (select user_txt, case when regexp_full_match(user_txt, '[0-9]+') then cast(user_txt as double) end v from ev)")
def mixed_stats(s, d):
    return A.mixed_stats(ev(s, d), "user_txt").select(F.round("mean", 6).alias("mean"), "min", "max", "others", "other_mode")


# versions


def _session(s, d) -> Session:
    df = ev(s, d)
    out = Session(df)
    out.apply("remove", df.where("ID % 7 = 0").select(ID))
    out.apply("impute", df.where("ID % 71 = 0").select(ID), column="kind")
    return out


@query(EV.rstrip(", ") + f" select {_EV5} from ev where \"ID\" % 7 <> 0")
def session_undo(s, d):
    return _session(s, d).undo().table.select(ID, "user_txt", "kind", "tag", "value")


@query(EV.replace("with ev as", "with ev0 as") + f"""ev as (select * from ev0 where "ID" % 7 <> 0) select "ID", case when "ID" % 71 = 0 then m else kind end as kind from ev, {_MODE}""")
def session_redo(s, d):
    out = _session(s, d)
    out.undo()
    return out.redo().table.select(ID, "kind")


@query(EV.rstrip(", ") + f" select {_EV5} from ev")
def session_original(s, d):
    return _session(s, d).original.table.select(ID, "user_txt", "kind", "tag", "value")


@query(_without("event_id % 7 <> 0") + " where row_id between 100 and 900")
def session_slice(s, d):
    """The errors of the current version's slice."""
    df = ev(s, d)
    out = Session(df)
    out.apply("remove", df.where("ID % 7 = 0").select(ID))
    return out.window(100, 900)[1]


@query(EV.rstrip(", ") + f' select "ID", case when "ID" % 10 = 0 then m else value end as value from ev, {_MEAN}')
def preview_impute(s, d):
    """A preview leaves the history as it is."""
    df = ev(s, d)
    out = Session(df)
    seen = out.preview("impute", df.where("ID % 10 = 0").select(ID), column="value")
    if out.at or len(out.versions) > 1:
        raise AssertionError("a preview must not be a step")
    return seen.table.select(ID, "value")


# tables in and out


def _customer_csv(s, d) -> str:
    """The customers as several CSV files, in order of key."""
    path = shared_folder(s) + "/1 Customers.csv"
    customer_ = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    customer_.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").write.csv(path, header=True)
    return path


_CSV = "select row_number() over (order by c_custkey) as \"ID\", c_custkey, c_name, c_acctbal::double as c_acctbal, c_mktsegment from customer"


@query(_CSV)
def ingest_csv(s, d):
    """Upload, number in file order with inferred types, save and load."""
    folder = shared_folder(s)
    name = ingest(s, _customer_csv(s, d), folder)
    return load(s, name, folder)[0].select(ID, F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query(f"with t as ({_CSV}) select \"ID\" as row_id, 'c_name' as column_id, 'incomplete' as error_type from t where c_name in (select c_name from t group by 1 having count(*) < 3) union all select \"ID\", 'c_acctbal', 'anomaly' from t, (select avg(c_acctbal) m, stddev_samp(c_acctbal) s from t) where abs(c_acctbal - m) > 2 * s union all select \"ID\", 'c_custkey', 'anomaly' from t, (select avg(c_custkey) m, stddev_samp(c_custkey) s from t) where abs(c_custkey - m) > 2 * s")
def ingest_csv_errors(s, d):
    folder = shared_folder(s)
    return load(s, ingest(s, _customer_csv(s, d), folder), folder)[1]


@query(f"with t as ({_CSV}), r as (select * from t where \"ID\" not in (3, 5, 8)), a as (select round_even(avg(c_acctbal) filter (c_acctbal > 0), 1) as m from r) select \"ID\"::bigint as \"ID\", c_custkey, case when \"ID\" in (1, 2, 4) then m else c_acctbal end as c_acctbal from r, a")
def export_script_replay(s, d):
    """The exported script, run on the CSV file, gives the session's table."""
    source, target = _customer_csv(s, d), shared_folder(s)
    session = Session(with_id(read_csv(s, source, typed=True)))
    session.apply("remove", [3, 5, 8])
    session.apply("impute", [1, 2, 4], column="c_acctbal")
    exec(compile(session.script(source, target), "script", "exec"), {})  # noqa: S102  our own text
    out = read_csv(s, target, typed=True)
    return out.select(F.col(ID).cast("long").alias(ID), F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query('select row_number() over (order by p_partkey) as "ID", p_partkey as "Original_ID", p_brand from part union all select (select count(*) from part) + 1, 1, \'again\'')
def assign_id_file_order(s, d):
    """An ID that is not unique is kept aside, and rows are numbered as they lie in their file."""
    path = shared_folder(s)
    own = part(s, d).select(ID, "p_brand").unionByName(s.createDataFrame([(1, "again")], "ID long, p_brand string"))
    last = F.when(F.col("p_brand") == "again", 1).otherwise(0)
    own.coalesce(1).sortWithinPartitions(last, ID).write.parquet(path)
    return with_id(s.read.parquet(path)).select(ID, "Original_ID", "p_brand")


# extensions, registries, summaries of a range


@query(EV.rstrip(", ") + " select \"ID\" as row_id, 'tag' as column_id, 'long' as error_type from ev where length(tag) > 6")
def custom_detector(s, d):
    D.register_detector("long", lambda df: D.flagged(df, {"tag": F.length("tag") > 6}, "long"))
    try:
        return D.run_detectors(ev(s, d), ["long"])
    finally:
        D.DETECTORS.pop("long")


@query(EVE + "select row_id, column_id, error_type from errs where error_type in ('missing', 'incomplete')")
def detectors_by_name(s, d):
    return D.run_detectors(ev(s, d), ["incomplete", "missing"])


@query(EV.rstrip(", ") + " select \"ID\", case when \"ID\" % 5 = 0 then 0 else value end as value from ev")
def custom_wrangler(s, d):
    def zero(df, ids, column):
        hit = ids.select(F.col(ID).alias("hit"))
        return df.join(hit, df[ID] == hit["hit"], "left").withColumn(column, F.when(F.col("hit").isNotNull(), 0.0).otherwise(F.col(column))).drop("hit")

    W.register_wrangler("zero", zero)
    try:
        df = ev(s, d)
        return Session(df).preview("zero", df.where("ID % 5 = 0").select(ID), column="value").table.select(ID, "value")
    finally:
        W.WRANGLERS.pop("zero")


_CLIENT_MODE = "(select kind as m from ev where kind is not null group by kind order by count(*) desc, min(\"ID\") desc limit 1)"


@query(EV.rstrip(", ") + f" select ev.\"ID\", case when \"ID\" % 71 = 0 then a.m else kind end as kind, case when \"ID\" % 71 = 0 then b.m else value end as value from ev, {_CLIENT_MODE} a, (select cast(printf('%.1f', avg(value) filter (value > 0)) as double) as m from ev) b")
def impute_client(s, d):
    df = ev(s, d)
    ids = df.where("ID % 71 = 0").select(ID)
    return W.WRANGLERS["impute"](W.WRANGLERS["impute"](df, ids, "kind", client=True), ids, "value", client=True).select(ID, "kind", "value")


@query(EVE + """, t as (select * from ev where "ID" between 1 and 500), e as (select * from errs where row_id between 1 and 500)
select 'ID' as column_id, 'numeric' as kind, round(avg("ID"), 6) as mean, min("ID")::double as min, max("ID")::double as max, null as mode, 0 as kinds_of_error from t
union all select 'value', 'numeric', round(avg(value), 6), min(value), max(value), null, (select count(distinct error_type) from e where column_id = 'value') from t
union all select 'user_txt', 'numeric', round(avg(v), 6), min(v), max(v), null, (select count(distinct error_type) from e where column_id = 'user_txt') from (select try_cast(user_txt as double) v from t)
union all select c, 'categorical', null, null, null, (select v from (select coalesce(x, 'N/A') v, count(*) n from (select case c when 'kind' then kind when 'tag' then tag else blank end x from t) group by 1) order by n desc, v limit 1), (select count(distinct error_type) from e where column_id = c) from (values ('kind'), ('tag'), ('blank')) u(c)""")
def attribute_summary_range(s, d):
    """Kinds, statistics and error maps of a range of rows, in one relation."""
    df = ev(s, d)
    got = Session(df, D.run_detectors(df)).summary(1, 500)
    kinds = F.broadcast(s.createDataFrame([*got["kinds"].items()], "column_id string, kind string"))
    stats = got["numeric"].select("column_id", F.round("mean", 6).alias("mean"), "min", "max", F.lit(None).cast("string").alias("mode"))
    stats = stats.unionByName(got["categorical"].select("column_id", "mode"), allowMissingColumns=True)
    maps = got["errors"].select("column_id", F.size("errors").cast("long").alias("kinds_of_error"))
    return kinds.join(stats, "column_id").join(maps, "column_id", "left").na.fill(0, ["kinds_of_error"])


@query("select distinct c_name, case when length(c_name) > 9 then substr(c_name, 1, 9) || '...' else c_name end as short from customer")
def shortened_text(s, d):
    return customer(s, d).select("c_name", shortened(F.col("c_name"), 9).alias("short")).distinct()


@query("select a as x, b as y, case when i = j then 'histogram' when j < i then 'scatter' else 'heatmap' end as chart from (values ('kind', 0), ('value', 1), ('tag', 2)) t(a, i), (values ('kind', 0), ('value', 1), ('tag', 2)) u(b, j)")
def plot_matrix(s, d):
    rows = [(x, y, chart) for line in P.plot_matrix(["kind", "value", "tag"]) for chart, x, y in line]
    return s.createDataFrame(rows, "x string, y string, chart string")


@query(EVE + "select row_id, column_id, error_type from errs where column_id in ('user_txt', 'kind') and error_type = 'missing' or column_id = 'value' and error_type = 'anomaly'")
def stream_errors(s, d):
    """The row-local rules on a stream of the events, with limits fitted on the batch."""
    work = shared_folder(s)
    ev(s, d).write.parquet(f"{work}/in")
    limits = fit_limits(ev(s, d), ["value"])
    stream = s.readStream.schema(ev(s, d).schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    run = streamed(stream, limits, ["user_txt", "kind"]).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema(D.ERRORS).parquet(f"{work}/out")


# columns that mix numbers and text

_MIX = EVE + """, q as (select "ID", kind, user_txt, value, try_cast(user_txt as double) v from ev), m as (select min(v) a, max(v) b, min(value) c, max(value) d from q),
z as (select "ID", case when v is not null then 'numeric' when user_txt is not null then 'categorical' end xc, case when v is not null then len([i for i in range(1, 10) if a + i * (b - a) / 10 < v]) else -1 end xb, case when v is null then coalesce(user_txt, '') else '' end x,
case when kind is not null then 'categorical' end kc, coalesce(kind, '') k, case when value is not null then 'numeric' end vc, case when value is not null then len([i for i in range(1, 10) if c + i * (d - c) / 10 < value]) else -1 end vb from q, m) """


@query(_MIX + "select xc as class, xb as x_bin, x, error_type, count(*) as n from z join errs on row_id = z.\"ID\" where xc is not null and column_id = 'user_txt' group by all")
def hist1d_mixed_errors(s, d):
    df = ev(s, d)
    out = H.mixed_histogram(df, "user_txt", errors=D.run_detectors(df))
    return out.select("class", F.coalesce("x_bin", F.lit(-1)).alias("x_bin"), F.coalesce("x", F.lit("")).alias("x"), F.explode("errors").alias("error_type", "n"))


@query(_MIX + "select xc as x_class, xb as x_bin, x, kc as y_class, k as y, count(*) as items from z where xc is not null and kc is not null group by all")
def hist2d_mixed_observed(s, d):
    out = H.mixed_histogram_2d(ev(s, d), "user_txt", "kind")
    return out.select("x_class", F.coalesce("x_bin", F.lit(-1)).alias("x_bin"), F.coalesce("x", F.lit("")).alias("x"), "y_class", "y", "items")


@query(_MIX + ", o as (select xc, xb, x, vb, count(*) n from z where xc is not null and vc is not null group by all) select coalesce(xc, 'numeric') as x_class, coalesce(xb, i) as x_bin, coalesce(x, '') as x, coalesce(vb, j) as y_bin, coalesce(n, 0) as items from (select i, j from range(10) g(i), range(10) h(j)) full join o on xc = 'numeric' and xb = i and vb = j")
def hist2d_mixed_grid(s, d):
    out = H.mixed_histogram_2d(ev(s, d), "user_txt", "value")
    return out.select("x_class", F.coalesce("x_bin", F.lit(-1)).alias("x_bin"), F.coalesce("x", F.lit("")).alias("x"), "y_bin", "items")


@query(EVE + """, own as (select distinct row_id from errs where column_id in ('user_txt', 'value')),
a as (select "ID" from ev where "ID" in (select row_id from own) order by md5("ID" || '0'), "ID" limit 30),
b as (select "ID" from ev where "ID" not in (select row_id from own) order by md5("ID" || '0'), "ID" limit (select greatest(0, 100 - count(*)) from a))
select ev."ID", case when try_cast(user_txt as double) is not null then 'numeric' else 'categorical' end as "xType", case when value is not null then 'numeric' else 'categorical' end as "yType", coalesce(user_txt, 'null') as x from ev where "ID" in (select * from a union all select * from b)""")
def scatter_mixed(s, d):
    df = ev(s, d)
    return S.mixed_entries(df, D.run_detectors(df), "user_txt", "value").select(ID, "xType", "yType", "x")


@query("select v as value, row_number() over (order by case v when 'Low' then 1 when 'Medium' then 2 else 3 end) as place from (values ('High'), ('Low'), ('Medium')) t(v)")
def category_order_levels(s, d):
    level = F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), F.pmod("p_partkey", F.lit(3)).cast("int") + 1)
    df = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias(ID), "p_partkey").withColumn("level", level)
    return A.category_order(df, "level").select("value", F.col("place").cast("long").alias("place"))


@query("select v as value, row_number() over (order by try_cast(nullif(regexp_extract(v, '^([0-9]+)', 1), '') as bigint) nulls last, v) as place from (select distinct o_orderpriority v from orders union select distinct o_orderstatus from orders)")
def category_order_text(s, d):
    both = orders(s, d)
    df = both.select(ID, F.col("o_orderpriority").alias("v")).unionByName(both.select(ID, F.col("o_orderstatus").alias("v")))
    return A.category_order(df, "v").select("value", F.col("place").cast("long").alias("place"))
