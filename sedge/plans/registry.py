"""The registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import (
    Float64, Str, across, case_when, coalesce, col, contains, cum_max, cum_min, cum_sum, dense_rank, desc, ends_with, everything,
    if_else, is_numeric, lag, lead, matches, min_rank, n, percent_rank, read, replace_na, row_number, starts_with, where,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of t, which gives a table as a frame, with its SQL. Sets of rows are compared, so none is sorted for display."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read(f"{sf_dir}/{name}.parquet")).to_spark(ordered=False)
        SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


LINE = "CAST(l_linenumber AS BIGINT) AS l_linenumber"


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc
          FROM lineitem WHERE l_quantity < 40 GROUP BY ALL""")
def q1_pricing_summary(t):
    return t("lineitem").filter(col.l_quantity < 40).group_by("l_returnflag", "l_linestatus").summarize(n=n(), qty=col.l_quantity.sum().round(2), disc=col.l_discount.mean().round(6))


@query(f"SELECT l_orderkey, {LINE} FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT l_discount > 0.05")
def filter_basic(t):
    return t("lineitem").filter(col.l_quantity.between(10, 20), col.l_returnflag.is_in(["A", "R"]), ~(col.l_discount > 0.05)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, length(p_type) AS len FROM part WHERE regexp_matches(p_type, '^[A-M].*[A-Z]$')")
def strings(t):
    p = t("part").filter(col.p_type.str_detect("^[A-M].*[A-Z]$"))
    return p.mutate(low=col.p_name.str_to_lower(), up=col.p_brand.str_to_upper(), len=col.p_type.str_len()).select("p_partkey", "low", "up", "len")


@query("SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS r FROM part")
def str_replace_first(t):
    return t("part").mutate(r=col.p_type.str_replace("[AEIOU]", "_")).select("p_partkey", "r")


@query(f"""SELECT l_orderkey, {LINE}, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / (l_quantity - l_quantity) AS inf,
           l_orderkey - 7 * CAST(floor(l_orderkey / 7) AS BIGINT) AS md, CAST(floor(l_orderkey / 7) AS BIGINT) AS dv, pow(l_quantity, 2) AS sq
           FROM lineitem""")
def mutate_arith(t):
    x = t("lineitem").mutate(net=col.l_extendedprice * (1 - col.l_discount), inf=col.l_extendedprice / (col.l_quantity - col.l_quantity), md=col.l_orderkey % 7, dv=col.l_orderkey // 7, sq=col.l_quantity**2)
    return x.select("l_orderkey", "l_linenumber", "net", "inf", "md", "dv", "sq")


@query("""SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' END AS band, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS flag,
          coalesce(nullif(event_type, 'click'), 'none') AS kind, year(ts) AS y, month(ts) AS m, day(ts) AS d FROM events""")
def mutate_cases(t):
    e = t("events").mutate(band=case_when((col.value > 50, "high"), (col.value > 10, "mid")), flag=if_else(col.value > 50, 1.0, 0.0))
    e = e.mutate(kind=replace_na(if_else(col.event_type == "click", None, col.event_type), "none"), y=col.ts.year(), m=col.ts.month(), d=col.ts.day())
    return e.select("event_id", "band", "flag", "kind", "y", "m", "d")


@query("SELECT o_orderkey, round(ln(o_totalprice), 6) AS l, round(sqrt(o_totalprice), 6) AS s, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, abs(0 - o_totalprice) AS a FROM orders")
def mutate_math(t):
    return t("orders").mutate(l=col.o_totalprice.log().round(6), s=col.o_totalprice.sqrt().round(6), f=col.o_totalprice.floor(), c=col.o_totalprice.ceiling(), a=(0 - col.o_totalprice).abs()).select("o_orderkey", "l", "s", "f", "c", "a")


@query(f"SELECT l_orderkey, {LINE}, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey), 4) AS dev FROM lineitem")
def grouped_mutate_mean(t):
    return t("lineitem").group_by("l_suppkey").mutate(dev=(col.l_extendedprice - col.l_extendedprice.mean()).round(4)).ungroup().select("l_orderkey", "l_linenumber", "dev")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def ungrouped_filter_mean(t):
    return t("orders").filter(col.o_totalprice > col.o_totalprice.mean()).select("o_orderkey", "o_totalprice")


@query("SELECT s_nationkey, s_suppkey FROM (SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, s_suppkey, s_acctbal, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM supplier) WHERE s_acctbal = m")
def grouped_filter_max(t):
    return t("supplier").group_by("s_nationkey").filter(col.s_acctbal == col.s_acctbal.max()).select("s_suppkey")


@query("""SELECT l_suppkey, round(median(l_extendedprice), 4) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 5) AS va, min(l_quantity) AS lo,
          max(l_quantity) AS hi, count(DISTINCT l_partkey) AS parts, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS deep FROM lineitem GROUP BY 1""")
def summ_stats(t):
    g = t("lineitem").group_by("l_suppkey")
    return g.summarize(med=col.l_extendedprice.median().round(4), sd=col.l_quantity.std().round(6), va=col.l_quantity.var().round(5), lo=col.l_quantity.min(), hi=col.l_quantity.max(), parts=col.l_partkey.n_unique(), deep=(col.l_discount > 0.05).sum())


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS l FROM events GROUP BY 1")
def summ_first_last(t):
    return t("events").arrange("ts", "event_id").group_by("user_id").summarize(f=col.value.first(), l=col.value.last())


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def count_two(t):
    return t("orders").count("o_orderstatus", "o_orderpriority")


@query("SELECT l_returnflag, count(*) AS statuses, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def rollup_chain(t):
    return t("lineitem").group_by("l_returnflag", "l_linestatus").summarize(k=n()).summarize(statuses=n(), rows=col.k.sum())


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_columns(t):
    return t("lineitem").distinct("l_returnflag", "l_linestatus")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def arrange_head(t):
    return t("orders").arrange(desc(col.o_totalprice), "o_orderkey").select("o_orderkey", "o_totalprice").slice_head(20)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2")
def slice_tail_grouped(t):
    return t("events").arrange("ts", "event_id").group_by("user_id").slice_tail(2).select("event_id")


@query("SELECT CAST(p_size AS BIGINT) AS p_size, p_partkey FROM (SELECT *, rank() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC) AS r FROM part) WHERE r <= 3")
def slice_max_ties(t):
    return t("part").group_by("p_size").slice_max(col.p_retailprice, n=3).select("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 7")
def slice_min_no_ties(t):
    return t("part").arrange("p_partkey").slice_min("p_retailprice", n=7, with_ties=False).select("p_partkey")


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
          ORDER BY ((((i + 42) % 2147483647) * 48271 % 2147483647) * 48271) % 2147483647, i LIMIT 25""")
def slice_sample_seeded(t):
    return t("customer").arrange("c_custkey").slice_sample(25, seed=42).select("c_custkey")


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_inner_star(t):
    o = t("orders").rename(c_custkey="o_custkey").inner_join(t("customer"), on="c_custkey").rename(n_nationkey="c_nationkey")
    return o.inner_join(t("nation"), on="n_nationkey").group_by("n_name").summarize(n=n(), total=col.o_totalprice.sum().round(2))


# whole tables; with this factor keys of either side miss the other at every scale
_S = "(SELECT s_suppkey * 17 AS k, s_acctbal AS v FROM supplier)"
_C = "(SELECT c_custkey AS k, c_acctbal AS v FROM customer)"


def _sides(t):
    return t("supplier").mutate(k=col.s_suppkey * 17).rename(v="s_acctbal").select("k", "v"), t("customer").rename(k="c_custkey", v="c_acctbal").select("k", "v")


for _how, _sql in (("left", "l.k"), ("right", "r.k"), ("full", "coalesce(l.k, r.k)")):

    def _join(t, how=_how):
        left, right = _sides(t)
        return getattr(left, f"{how}_join")(right, on="k")

    _join.__name__ = f"join_{_how}"
    query(f'SELECT {_sql} AS k, l.v AS "v.x", r.v AS "v.y" FROM {_S} l {_how} JOIN {_C} r ON l.k IS NOT DISTINCT FROM r.k')(_join)


@query(f"SELECT k, v FROM {_S} l WHERE EXISTS (SELECT 1 FROM {_C} r WHERE r.k = l.k)")
def join_semi(t):
    left, right = _sides(t)
    return left.semi_join(right, on="k")


@query(f"SELECT k, v FROM {_S} l WHERE NOT EXISTS (SELECT 1 FROM {_C} r WHERE r.k = l.k)")
def join_anti(t):
    left, right = _sides(t)
    return left.anti_join(right, on="k")


_NA = "(SELECT CASE WHEN n_regionkey = 1 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS k, n_name FROM nation) l, (SELECT CASE WHEN r_regionkey = 1 THEN NULL ELSE CAST(r_regionkey AS BIGINT) END AS k, r_name FROM region) r"


def _na_sides(t):
    blank = lambda c: if_else(c == 1, None, c)
    return t("nation").mutate(k=blank(col.n_regionkey)).select("k", "n_name"), t("region").mutate(k=blank(col.r_regionkey)).select("k", "r_name")


@query(f"SELECT l.k, n_name, r_name FROM {_NA} WHERE l.k IS NOT DISTINCT FROM r.k")
def join_na_matches(t):
    left, right = _na_sides(t)
    return left.inner_join(right, on="k")


@query(f"SELECT l.k, n_name, r_name FROM {_NA} WHERE l.k = r.k")
def join_na_never(t):
    left, right = _na_sides(t)
    return left.inner_join(right, on="k", na_matches="never")


@query("""SELECT user_id, event_id, lag(value) OVER w AS a, lead(value, 2, 0.0) OVER w AS b, row_number() OVER w AS r, round(sum(value) OVER w, 3) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def windows_ordered(t):
    e = t("events").arrange("ts", "event_id").group_by("user_id")
    return e.mutate(a=lag(col.value), b=lead(col.value, 2, 0.0), r=row_number(), s=cum_sum(col.value).round(3), lo=cum_min(col.value), hi=cum_max(col.value)).select("event_id", "a", "b", "r", "s", "lo", "hi")


@query("""SELECT event_id, lag(value) OVER w AS a, lead(value, 2, 0.0) OVER w AS b, row_number() OVER w AS r, round(sum(value) OVER u, 3) AS s, min(value) OVER u AS lo, max(value) OVER u AS hi
          FROM events WINDOW w AS (ORDER BY ts, event_id), u AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def windows_whole(t):
    e = t("events").arrange("ts", "event_id")
    return e.mutate(a=lag(col.value), b=lead(col.value, 2, 0.0), r=row_number(), s=cum_sum(col.value).round(3), lo=cum_min(col.value), hi=cum_max(col.value)).select("event_id", "a", "b", "r", "s", "lo", "hi")


@query("SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p FROM part WINDOW w AS (ORDER BY p_retailprice DESC)")
def ranks_whole(t):
    return t("part").mutate(r=min_rank(desc(col.p_retailprice)), d=dense_rank(desc(col.p_retailprice)), p=percent_rank(desc(col.p_retailprice)).round(9)).select("p_partkey", "r", "d", "p")


@query("SELECT p_partkey, p_retailprice FROM (SELECT *, rank() OVER (ORDER BY p_retailprice DESC) AS r FROM part) WHERE r <= 10")
def slice_max_whole(t):
    return t("part").slice_max(col.p_retailprice, n=10).select("p_partkey", "p_retailprice")


@query("""SELECT CAST(p_size AS BIGINT) AS p_size, p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p FROM part
          WINDOW w AS (PARTITION BY p_size ORDER BY p_retailprice) QUALIFY count(*) OVER (PARTITION BY p_size) > 1""")
def windows_ranks(t):
    p = t("part").group_by("p_size").mutate(r=min_rank(col.p_retailprice), d=dense_rank(col.p_retailprice), p=percent_rank(col.p_retailprice).round(9))
    return p.filter(n() > 1).select("p_partkey", "r", "d", "p")


@query("SELECT c_custkey, name, value FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal FROM customer) UNPIVOT (value FOR name IN (c_nationkey, c_acctbal))")
def pivot_longer(t):
    return t("customer").select("c_custkey", "c_nationkey", "c_acctbal").pivot_longer("c_nationkey", "c_acctbal")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def pivot_wider(t):
    return t("orders").count("o_orderpriority", "o_orderstatus").pivot_wider("o_orderstatus", "n").mutate(F=coalesce(col.F, 0), O=coalesce(col.O, 0), P=coalesce(col.P, 0))


@query("""SELECT p_partkey, string_split(p_type, ' ')[1] AS a, string_split(p_type, ' ')[2] AS b, p_brand || '-' || CAST(p_size AS VARCHAR) AS u FROM part""")
def separate_unite(t):
    p = t("part").select("p_partkey", "p_type", "p_brand", "p_size").separate("p_type", ["a", "b"], sep=" ")
    return p.unite("u", ["p_brand", "p_size"], sep="-")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, round(avg(l_tax), 8) AS l_tax_mean, max(l_tax) AS l_tax_max FROM lineitem GROUP BY 1")
def across_summary(t):
    return t("lineitem").group_by("l_returnflag").summarize(across(["l_quantity", "l_tax"], ["mean", "max"])).mutate(l_quantity_mean=col.l_quantity_mean.round(6), l_tax_mean=col.l_tax_mean.round(8))


@query("SELECT c_acctbal, c_custkey, c_name, c_mktsegment FROM customer")
def select_relocate(t):
    return t("customer").select(starts_with("c_"), -contains("nation")).relocate(where(lambda k: k == Float64))


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, s_acctbal IS NULL AS no FROM supplier")
def cast_is_na(t):
    return t("supplier").mutate(nation=col.s_nationkey.cast(Str), no=col.s_acctbal.is_na()).select("s_suppkey", "nation", "no")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, NULL::DOUBLE AS m FROM orders WHERE o_orderkey < 0")
def summ_empty(t):
    return t("orders").filter(col.o_orderkey < 0).summarize(n=n(), s=col.o_custkey.sum(), m=col.o_totalprice.mean())


# missing values: every fifth value of a column is made null
_BLANK = "(SELECT *, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS x FROM part)"


def _blank(t):
    return t("part").mutate(x=if_else(col.p_partkey % 5 == 0, None, col.p_retailprice))


@query(f"""SELECT CAST(p_size AS BIGINT) AS p_size, CASE WHEN count(x) = count(*) THEN round(avg(x), 6) END AS m, CASE WHEN count(x) = count(*) THEN round(sum(x), 4) END AS s,
           round(avg(x), 6) AS mr, count(DISTINCT x) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS u FROM {_BLANK} GROUP BY 1""")
def summ_nulls(t):
    g = _blank(t).group_by("p_size")
    return g.summarize(m=col.x.mean(na_rm=False).round(6), s=col.x.sum(na_rm=False).round(4), mr=col.x.mean().round(6), u=col.x.n_unique())


@query(f"""SELECT p_partkey, CASE WHEN x IS NOT NULL THEN rank() OVER w END AS r, CASE WHEN x IS NOT NULL THEN dense_rank() OVER w END AS d,
           CASE WHEN x IS NOT NULL THEN round((rank() OVER w - 1) / (count(x) OVER (PARTITION BY p_brand) - 1), 9) END AS p
           FROM {_BLANK} WINDOW w AS (PARTITION BY p_brand ORDER BY x NULLS LAST)""")
def windows_ranks_nulls(t):
    g = _blank(t).group_by("p_brand")
    return g.mutate(r=min_rank(col.x), d=dense_rank(col.x), p=percent_rank(col.x).round(9)).ungroup().select("p_partkey", "r", "d", "p")


@query(f"""SELECT p_partkey, CASE WHEN x IS NOT NULL THEN round(sum(x) OVER w, 4) END AS s, CASE WHEN x IS NOT NULL THEN min(x) OVER w END AS lo, CASE WHEN x IS NOT NULL THEN max(x) OVER w END AS hi,
           lag(x) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a
           FROM {_BLANK} WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)""")
def windows_ordered_nulls(t):
    g = _blank(t).arrange("p_partkey").group_by("p_brand")
    return g.mutate(s=cum_sum(col.x).round(4), lo=cum_min(col.x), hi=cum_max(col.x), a=lag(col.x)).ungroup().select("p_partkey", "s", "lo", "hi", "a")


@query(f"SELECT p_partkey, x FROM {_BLANK} ORDER BY x DESC NULLS LAST, p_partkey LIMIT 50")
def arrange_nulls_last(t):
    return _blank(t).arrange(desc(col.x), "p_partkey").select("p_partkey", "x").slice_head(50)


@query("SELECT s_suppkey, true AS nan, false AS num, round(exp(s_nationkey / 10.0), 6) AS e FROM supplier")
def mutate_nan_exp(t):
    zero = col.s_suppkey - col.s_suppkey
    return t("supplier").mutate(nan=(zero / zero).is_na(), num=(zero + 1).is_na(), e=(col.s_nationkey / 10).exp().round(6)).select("s_suppkey", "nan", "num", "e")


@query("SELECT c_custkey, c_nationkey, c_name FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_name FROM customer)")
def select_patterns(t):
    return t("customer").select(ends_with("key"), matches("^c_na[a-m]e$"), -contains("seg"))


@query("SELECT s_acctbal, s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def select_everything(t):
    return t("supplier").relocate("s_acctbal", before="s_suppkey").relocate("s_nationkey", after="s_name").select(everything())


@query("SELECT c_mktsegment, n_name, count(*) AS n, round(max(c_acctbal), 2) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def join_grouped(t):
    c = t("customer").rename(n_nationkey="c_nationkey").group_by("c_mktsegment").inner_join(t("nation"), on="n_nationkey")
    return c.group_by("n_name").summarize(n=n(), top=col.c_acctbal.max().round(2))


@query("SELECT min(p_size) AS p_size_min, min(p_retailprice) AS p_retailprice_min, min(p_partkey) AS p_partkey_min FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part)")
def across_numbers(t):
    return t("part").summarize(across(where(is_numeric), ["min"]))


def _read_back(suffix: str):
    def run(t):
        from ..sources.io import scratch

        path = scratch(suffix)
        t("nation").select("n_nationkey", "n_name").write(path)
        return read(path).select("n_nationkey", "n_name")

    run.__name__ = f"read_{suffix}"
    return query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")(run)


for _suffix in ("csv", "tsv", "jsonl", "json", "parquet", "arrow"):
    _read_back(_suffix)
