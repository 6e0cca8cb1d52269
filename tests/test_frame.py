"""Semantics that the query comparison doesn't reach: missing values, order, errors, sources and sinks."""

import math
import re
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import sedge
from sedge import ColumnNotFoundError, DuplicateColumnError, ExprTypeError, GroupError, across, col, cum_sum, desc, if_else, lag, lit, n, read, row_number


@pytest.fixture(scope="module")
def people(spark):
    return read({"name": ["oak", "elm", "ash", "yew", "fir", "box"], "height": [310, 240, 285, 150, 402, 90], "mass": [61.5, 38.0, 64.0, 120.0, None, 9.0], "species": ["leafy", "leafy", "leafy", "needle", "spruce", None]})


def test_filter_drops_unknown(people):
    assert people.filter(col.mass > 60).pull("name") == ["oak", "ash", "yew"]


def test_division_by_zero(spark):
    x = read({"x": [2.0, -3.0, 0.0]}).mutate(y=col.x / 0).pull("y")
    assert x[:2] == [math.inf, -math.inf] and math.isnan(x[2])


def test_floor_mod_and_floor_division(spark):
    f = read({"x": [8, -8]})
    assert f.mutate(m=col.x % 3, d=col.x // 3, e=col.x % -3).collect().to_pydict() == {"x": [8, -8], "m": [2, 1], "d": [2, -3], "e": [-1, -2]}


def test_na_and_nan(spark):
    f = read(pa.table({"x": pa.array([2.5, float("nan"), None])}))
    assert f.mutate(y=col.x.is_na()).pull() == [False, True, True]
    assert f.mutate(y=col.x.is_in([])).pull() == [False, False, None]


def test_arrange_is_stable_and_na_is_last(spark):
    f = read({"k": [3, 1, 2, None, 1, 3], "tag": list("uvwxyz")})
    assert f.arrange("k").pull("tag") == list("vywuzx")
    assert f.arrange(desc(col.k)).pull("tag") == list("uzwvyx")
    assert f.arrange("tag").arrange("k").mutate(k=lit(0)).pull("tag") == list("vywuzx")


def test_first_and_last_follow_arrange(spark):
    f = read({"g": list("ppqqp"), "x": [4, 8, 5, 2, 6]})
    out = f.arrange(desc(col.x)).group_by("g").summarize(f=col.x.first(), l=col.x.last()).collect().to_pydict()
    assert out == {"g": ["p", "q"], "f": [8, 5], "l": [4, 2]}


def test_aggregates_of_missing_values(people):
    out = people.summarize(a=col.mass.mean(na_rm=False), b=col.mass.sum(), c=col.species.n_unique(), d=(col.height > 100).sum())
    assert out.collect().to_pylist() == [{"a": None, "b": 292.5, "c": 4, "d": 5}]


def test_summarize_peels_one_group(people):
    g = people.group_by("species", "name").summarize(k=n())
    assert g.groups == ("species",) and isinstance(g, sedge.GroupedFrame)
    assert people.count("species").pull("species") == ["leafy", "needle", "spruce", None]


def test_mutate_later_sees_earlier(people):
    out = people.mutate(a=col.height * 2, b=col.a + 1, height=col.height + 1).select("height", "a", "b").slice_head(1)
    assert out.collect().to_pylist() == [{"height": 311, "a": 620, "b": 621}]


def test_windows_in_filter(people):
    assert people.group_by("species").filter(row_number() == 1).ungroup().pull("name") == ["oak", "yew", "fir", "box"]


def test_errors_come_at_once(people):
    with pytest.raises(ColumnNotFoundError, match="did you mean 'height'"):
        people.filter(col.heigth > 1)
    with pytest.raises(ExprTypeError):
        people.mutate(x=col.name + 1)
    with pytest.raises(ExprTypeError):
        people.summarize(x=col.mass)
    with pytest.raises(ExprTypeError):
        people.summarize(x=row_number())
    with pytest.raises(GroupError):
        people.group_by()
    with pytest.raises(DuplicateColumnError):
        people.rename(name="height")
    with pytest.raises(ExprTypeError):
        bool(col.mass > 1 and col.mass < 2)


def test_pivot_wider_warns_and_keeps_first(spark):
    f = read({"id": [7, 7, 8], "k": ["m", "m", None], "v": [4, 5, 6]})
    with pytest.warns(UserWarning):
        out = f.pivot_wider("k", "v")
    assert sorted(map(str, out.collect().to_pylist())) == ["{'id': 7, 'm': 4, 'null': None}", "{'id': 8, 'm': None, 'null': 6}"]


def test_pivot_wider_takes_names_and_values_by_the_order_of_rows(spark):
    f = read({"id": [1, 1, 2, 2, 1], "k": ["c", "a", "b", "a", "a"], "v": [1, 2, 3, 4, 5]})
    with pytest.warns(UserWarning):
        assert f.pivot_wider("k", "v").columns == ["id", "c", "a", "b"]
    for order, columns, a in (("v", ["id", "c", "a", "b"], 2), (desc(col.v), ["id", "a", "b", "c"], 5), (desc(col.k), ["id", "c", "b", "a"], 2)):
        with pytest.warns(UserWarning):
            out = f.arrange(order).pivot_wider("k", "v")
        assert out.columns == columns and out.filter(col.id == 1).pull("a") == [a]


def test_separate_and_unite(spark):
    f = read({"id": [4, 5, 6], "code": ["red_sky", "no_sea_air", "sand"]}).separate("code", ["l", "r"])
    assert f.collect().to_pydict() == {"id": [4, 5, 6], "l": ["red", "no", "sand"], "r": ["sky", "sea", None]}
    u = read({"a": ["up", None], "b": ["to", None], "z": [7, 8]})
    assert u.unite("u", ["a", "b"]).pull("u") == ["up_to", "NA_NA"] and u.unite("u", ["a", "b"], na_rm=True).pull("u") == ["up_to", ""]


def test_selectors_and_across(people):
    assert people.select(-sedge.contains("a")).columns == ["height", "species"]
    assert people.summarize(across(sedge.where(sedge.is_numeric), ["min", "max"])).columns == ["height_min", "height_max", "mass_min", "mass_max"]


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("suffix", ["parquet", "csv", "tsv", "csv.gz", "tsv.gz", "jsonl", "json", "arrow"])
def test_round_trip(spark, tmp_path, suffix, single):
    at, rows = tmp_path / f"t.{suffix}", {"g": ["p", "q", "r"], "x": [0.25, 8.0, -3.5]}
    for _ in range(2):  # the second time over the first
        read(rows).write(str(at), single=single)
        assert at.is_file() == single
    assert read(str(at)).select("g", "x").arrange("g").collect().to_pydict() == rows
    read(rows).filter(col.x > 99).write(str(at), single=single)
    assert suffix == "jsonl" or len(read(str(at))) == 0


def test_sinks_and_sources_run_in_several_tasks(blocks, tmp_path, monkeypatch):
    monkeypatch.setattr("sedge.sources.io.RANGE", 100)
    data = numbers()
    f = read(pa.Table.from_pandas(data, preserve_index=False)).arrange("i")
    f = sedge.Frame(f.to_spark().repartitionByRange(4, "i")).arrange("i")
    want = data.sort_values("i")
    for suffix in ("arrow", "json"):
        f.write(str(tmp_path / f"t.{suffix}"))
        assert len(list((tmp_path / f"t.{suffix}").glob("part-*"))) > 1
        back = read(str(tmp_path / f"t.{suffix}")).arrange("i")
        assert back.pull("i") == list(range(500)) and back.pull("s") == want.s.tolist()
    f.write(str(tmp_path / "t.duckdb"), table="t")
    with pytest.warns(UserWarning):
        back = read(str(tmp_path / "t.duckdb"))
    assert back.to_spark().rdd.getNumPartitions() == 5 and back.pull("i") == list(range(500))
    import sqlite3

    with sqlite3.connect(tmp_path / "t.sqlite") as con:
        con.execute("CREATE TABLE t (i INTEGER, s TEXT, r REAL)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(int(i), s, i / 2) for i, s in zip(want.i, want.s)])
    back = read(str(tmp_path / "t.sqlite"))
    assert back.to_spark().rdd.getNumPartitions() == 5 and back.pull("i") == list(range(500)) and back.pull("r")[:3] == [0.0, 0.5, 1.0]


def test_distinct_keeps_the_order_of_first_rows(spark):
    f = read({"k": ["b", "a", "b", "c", "a"], "x": [5, 4, 3, 2, 1]})
    assert f.distinct("k").pull() == ["b", "a", "c"] and f.arrange("x").distinct("k").pull() == ["a", "c", "b"]
    assert f.arrange(desc(col.k)).distinct("k").pull() == ["c", "b", "a"]


def test_medians_beside_distinct_counts(people):
    out = people.group_by("species").summarize(u=col.name.n_unique(), m=col.height.median(), k=n()).collect().to_pylist()
    assert out == [{"species": "leafy", "u": 3, "m": 285.0, "k": 3}, {"species": "needle", "u": 1, "m": 150.0, "k": 1}, {"species": "spruce", "u": 1, "m": 402.0, "k": 1}, {"species": None, "u": 1, "m": 90.0, "k": 1}]


def test_typed_columns_refuse_what_does_not_fit(people):
    c = people.mutate(tall=col.height > 200).c
    assert (type(c.height), type(c.name), type(c.tall)) == (sedge.NumExpr, sedge.StrExpr, sedge.BoolExpr)
    for call in (c.height.str_len, c.name.mean, c.tall.abs, c.height.year, c.tall.year):
        with pytest.raises(ExprTypeError):
            call()
    assert people.mutate(tall=col.height > 200).summarize(k=c.tall.sum(), m=c.height.max()).collect().to_pylist() == [{"k": 4, "m": 402}]
    assert people.mutate(x=c.name.str_len() + c.height).pull("x")[0] == 313


def test_generated_modules(people, tmp_path, monkeypatch):
    from sedge import stubs

    people.rename(**{"the mass": "mass"}).write(str(tmp_path / "old trees.parquet"))
    assert stubs.main([str(tmp_path / "old trees.parquet"), "-o", str(tmp_path / "made_tables.py")]) == 0
    monkeypatch.syspath_prepend(tmp_path)
    import made_tables

    assert made_tables.OldTreesColumns.__annotations__ == {"name": "StrExpr", "height": "NumExpr", "the_mass": "NumExpr", "species": "StrExpr"}
    assert made_tables.read_old_trees().pull("name") == people.pull("name")


def test_errors_show_one_frame_of_the_library(people):
    import traceback

    for call in (lambda: people.filter(col.heigth > 1), lambda: people.mutate(x=col.name + 1)):
        try:
            call()
        except (ColumnNotFoundError, ExprTypeError) as error:
            assert sum("/sedge/" in f.filename for f in traceback.extract_tb(error.__traceback__)) == 1


def test_named_constructors_views_and_engines(people):
    rows = {"x": [1, 2]}
    for f in (sedge.Frame.from_dict(rows), sedge.Frame.from_pandas(pd.DataFrame(rows)), sedge.Frame.from_arrow(pa.table(rows))):
        assert f.collect(engine="spark").to_pydict() == rows
    with pytest.raises(sedge.BackendError):
        people.collect(engine="other")
    assert people.to_view("some_trees").pull("name") == people.pull("name") and people.to_view("all_trees", temporary=False).pull("name") == people.pull("name")
    assert "name" in people.plan
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 3 AS x")
    with pytest.warns(UserWarning):
        assert sedge.Frame.from_duckdb(con, "t").pull() == [3]
    assert sedge.read_sql("SELECT x + 1 AS y FROM t", con).pull() == [4]


def test_databases(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "t.sqlite") as con:
        con.execute("CREATE TABLE trees (name TEXT, rings INTEGER)")
        con.execute("INSERT INTO trees VALUES ('oak', 120), ('elm', 80)")
    assert read(str(tmp_path / "t.sqlite")).pull("rings") == [120, 80]
    read(pd.DataFrame({"x": [1]})).write(str(tmp_path / "d.duckdb"), table="t")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert read(str(tmp_path / "d.duckdb"), "t").pull() == [1]


def test_nested_columns_are_refused(spark):
    with pytest.raises(ExprTypeError):
        read("/root/testdata/sf0.001/embeddings.parquet")


def test_persist_and_null_condition(people):
    assert people.arrange("height").persist().pull("name")[0] == "box"
    assert people.mutate(x=if_else(None, 1, 2)).pull("x") == [2] * 6


def test_filters_and_columns_reach_the_scan(spark):
    plan = read("/root/testdata/sf0.001/lineitem.parquet").filter(col.l_quantity > 10).select("l_orderkey").show_query()
    assert "GreaterThan(l_quantity,10.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


@pytest.fixture()
def blocks(spark):
    """Sorts leave all their partitions, so that windows cross many blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def numbers(seed: int = 3, size: int = 500) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = pd.array(rng.integers(0, 20, size), dtype="Int64")
    x[rng.random(size) < 0.1] = pd.NA
    return pd.DataFrame({"i": rng.permutation(size), "x": x, "s": rng.choice(list("abc"), size)})


@pytest.mark.parametrize("chunk", [1 << 18, 7, 2])
def test_windows_of_ungrouped_frames(blocks, monkeypatch, chunk):
    monkeypatch.setattr("sedge.operators.places.CHUNK", chunk)
    data = numbers()
    f = read(pa.Table.from_pandas(data, preserve_index=False))
    made = f.arrange("i").mutate(
        r=row_number(), a=sedge.lag(col.x, 3), b=sedge.lead(col.x, 2, -1), s1=sedge.cum_sum(col.x), lo=sedge.cum_min(col.x), hi=sedge.cum_max(col.x),
        m=sedge.min_rank(col.x), d=sedge.dense_rank(desc(col.x)), p=sedge.percent_rank(col.x), f=col.s.first(), l=col.s.last(), z=sedge.cum_sum(sedge.lag(col.x)),
    ).to_pandas()
    want = data.sort_values("i").reset_index(drop=True)
    x = want.x.astype("Float64")
    number = pd.Series(x.to_numpy(float, na_value=np.nan))  # for ranks, NaN where x is missing
    same = lambda a, b: np.testing.assert_allclose(a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan))
    assert made.i.tolist() == want.i.tolist() and made.r.tolist() == list(range(1, 501))
    same(made.a, x.shift(3))
    same(made.b, x.shift(-2).where(want.index < 498, -1))
    same(made.s1, x.cumsum())
    same(made.lo, x.cummin())
    same(made.hi, x.cummax())
    same(made.m, number.rank(method="min"))
    same(made.d, number.rank(method="dense", ascending=False))
    same(made.p, (number.rank(method="min") - 1) / (number.count() - 1))
    same(made.z, x.shift(1).cumsum())
    assert set(made.f) == {want.s.iloc[0]} and set(made.l) == {want.s.iloc[-1]}


def test_windows_of_empty_and_unarranged_frames(blocks):
    f = read({"x": [5, 9, 4], "v": [None, None, None]})
    assert f.mutate(a=lag(col.x), c=cum_sum(col.x)).collect().to_pydict() == {"x": [5, 9, 4], "v": [None] * 3, "a": [None, 5, 9], "c": [5, 14, 18]}
    assert f.filter(col.x > 9).mutate(a=lag(col.x), r=row_number(), m=sedge.min_rank(col.x)).pull("r") == []
    assert f.filter(row_number() == 2).pull("x") == [9] and f.arrange(desc(lag(col.x))).pull("x") == [4, 9, 5]


def test_extremes_with_ties_of_ungrouped_frames(blocks):
    data = numbers()
    f = read(pa.Table.from_pandas(data, preserve_index=False))
    for n_rows in (0, 1, 30, 499):
        least = data.x.dropna().sort_values()
        want = data[data.x.notna() & (data.x <= least.iloc[: max(1, n_rows)].max())] if n_rows else data[:0]
        assert sorted(f.slice_min("x", n=n_rows).pull("i")) == sorted(want.i)
    assert set(f.slice_max("x").pull("x")) == {data.x.max()}


@pytest.mark.parametrize("keys", [("x", "i"), (desc(col.x), "i"), (desc(col.s), "i"), (desc(col.y), desc(col.i))])
def test_first_and_last_of_summaries(blocks, keys):
    f = read(pa.Table.from_pandas(numbers(), preserve_index=False)).mutate(y=if_else(col.x == 3, float("nan"), col.x / 2)).arrange(*keys)
    rows = f.collect().to_pylist()
    assert f.summarize(a=col.i.first(), b=col.i.last()).collect().to_pylist() == [{"a": rows[0]["i"], "b": rows[-1]["i"]}]
    got = f.group_by("s").summarize(a=col.i.first(), b=col.i.last()).collect().to_pylist()
    assert got == [{"s": s, "a": (own := [r["i"] for r in rows if r["s"] == s])[0], "b": own[-1]} for s in "abc"]


def test_no_task_sorts_or_holds_all_rows(blocks):
    f = read("/root/testdata/sf0.001/lineitem.parquet").arrange("l_shipdate", "l_orderkey", "l_linenumber")
    plan = f.mutate(c=cum_sum(col.l_quantity), a=lag(col.l_tax)).show_query()
    for step in re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: SinglePartition", plan):
        assert "l_" not in step


@pytest.mark.parametrize("chunk", [1 << 18, 5])
def test_large_groups_go_by_blocks_with_the_same_results(blocks, monkeypatch, chunk):
    monkeypatch.setattr("sedge.operators.places.CHUNK", chunk)
    data = numbers()
    data["g"] = np.where(np.random.default_rng(5).random(500) < 0.6, None, data.s)  # more than half of all rows share the missing key
    f = read(pa.Table.from_pandas(data, preserve_index=False)).arrange("i").group_by("g", "s")

    def made():
        out = f.mutate(
            r=row_number(), a=sedge.lag(col.x, 2), b=sedge.lead(col.x, 1, -1), s1=sedge.cum_sum(col.x), lo=sedge.cum_min(col.x), hi=sedge.cum_max(col.x),
            m=sedge.min_rank(col.x), d=sedge.dense_rank(desc(col.x)), p=sedge.percent_rank(col.x), f=col.i.first(), l=col.i.last(), z=col.x - col.x.mean(),
        )
        return out.ungroup().collect().to_pylist(), f.filter(row_number() < 4).ungroup().pull("i")

    plain = made()
    monkeypatch.setattr("sedge.operators.frame.SMALL_FRAME", -1)
    monkeypatch.setattr("sedge.operators.frame.LARGEST_GROUP", 10)
    assert made() == plain
    assert [r["i"] for r in plain[0]] == list(range(500))
    monkeypatch.setattr("sedge.operators.frame.LARGEST_GROUP", 10**9)
    assert made() == plain


def test_windows_of_empty_grouped_frames(blocks, monkeypatch):
    f = read({"g": ["a", "b"], "x": [1, 2]}).filter(col.x > 5).group_by("g")
    monkeypatch.setattr("sedge.operators.frame.SMALL_FRAME", -1)
    for most in (-1, 10):
        monkeypatch.setattr("sedge.operators.frame.LARGEST_GROUP", most)
        assert f.mutate(r=row_number(), c=cum_sum(col.x), k=n(), m=sedge.min_rank(col.x)).pull("r") == []


@pytest.mark.parametrize("small", [-1, 1 << 40])
def test_aggregates_of_groups_beside_their_rows(people, monkeypatch, small):
    monkeypatch.setattr("sedge.operators.frame.SMALL_FRAME", small)
    g = people.group_by("species")
    out = g.mutate(k=n(), u=col.name.n_unique(), a=col.mass.mean(na_rm=False), med=col.height.median()).ungroup().select("name", "k", "u", "a", "med").arrange("name")
    assert out.pull("k") == [3, 1, 3, 1, 3, 1] and out.pull("u") == [3, 1, 3, 1, 3, 1] and out.pull("med") == [285.0, 90.0, 285.0, 402.0, 285.0, 150.0]
    assert ("Window" in g.mutate(a=col.mass - col.mass.mean()).show_query()) == (small > 0)


def test_display_options(people, monkeypatch):
    monkeypatch.setattr(sedge.options, "preview_rows", 2)
    assert "elm" in repr(people) and "ash" not in repr(people) and "..." in repr(people) and "<table" in people._repr_html_()
    assert "elm" not in repr(people.lazy().filter(col.height > 1)) and "<table" not in people.lazy()._repr_html_()
    monkeypatch.setattr(sedge.options, "interactive", False)
    assert "elm" not in repr(people) and "elm" in repr(people.eager().filter(col.height > 1))
    assert "&lt;Int64&gt;" in people._repr_html_()


def test_writers_by_name(people, tmp_path):
    for kind, suffix in (("parquet", "parquet"), ("csv", "csv"), ("ipc", "arrow")):
        getattr(people, f"write_{kind}")(str(tmp_path / f"{kind}.{suffix}"))
        assert read(str(tmp_path / f"{kind}.{suffix}")).pull("name") == people.pull("name")
    people.write_duckdb(str(tmp_path / "d.duckdb"), "people")
    with pytest.warns(UserWarning):
        assert read(str(tmp_path / "d.duckdb"), "people").pull("height") == people.pull("height")


def test_join_keys_are_checked_and_groups_stay(people):
    other = read({"species": ["leafy", "needle"], "shade": [1, 2]})
    with pytest.raises(ColumnNotFoundError):
        people.inner_join(other, on="heigth")
    with pytest.raises(ColumnNotFoundError):
        people.inner_join(other, on="height")
    with pytest.raises(ExprTypeError):
        people.inner_join(read({"species": [1]}), on="species")
    with pytest.raises(GroupError):
        people.inner_join(other.group_by("shade"), on="species")
    grouped = people.group_by("species").left_join(other, on="species")
    assert grouped.groups == ("species",) and grouped.summarize(s=col.shade.sum()).pull("s") == [3, 2, 0, 0]


def test_objects_of_other_libraries(spark):
    """By what they offer: those libraries aren't here."""

    class Polars:
        def to_arrow(self):
            return pa.table({"x": [1, 2]})

    class Lazy:
        def collect(self):
            return Polars()

    class Tensor:
        def numpy(self):
            return np.arange(6).reshape(3, 2)

    class Split:
        class data:
            table = pa.table({"x": [7]})

    assert read(Polars()).pull() == [1, 2] and sedge.Frame.from_polars(Lazy()).pull() == [1, 2]
    assert read(Tensor()).collect().to_pydict() == {"column_0": [0, 2, 4], "column_1": [1, 3, 5]}
    assert read(Split()).pull() == [7]


def test_logs_at_and_below_zero(spark):
    x = read({"x": [0.0, -1.0, 1.0]}).mutate(y=col.x.log()).pull("y")
    assert x[0] == -math.inf and math.isnan(x[1]) and x[2] == 0.0
