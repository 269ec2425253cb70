"""Golden values of small frames, in the mode in which sentinels stand for missing data."""

import numpy as np
import pandas as pd
import pytest

import pelagos as pg

pytestmark = pytest.mark.usefixtures("spark")
# The inputs of the golden tests below, and what they give.
TEXT = np.array([b"a", b"Abc", b"goosfraba", b"   dC  ", b"secrETariat"])


def small():
    return pg.DataFrame({"a": np.arange(1, 6, dtype=np.float32), "b": np.arange(1, 6), "c": TEXT}, pg.Index(np.arange(5)))


def df1():
    return pg.DataFrame({"a": np.arange(5), "b": np.arange(1, 6, dtype=np.float32)}, pg.Index(np.arange(2, 7)))


def df2():
    index = pg.MultiIndex([np.array([1, 3, 5]), np.array([b"abc", b"def", b"efgh"])], ["a", "d"])
    return pg.DataFrame({"b": np.array([3, 4, 5], np.float32), "c": np.array([4, 5, 6])}, index)


def duplicated():
    return pg.DataFrame({"a": np.array([0, 1, 1, 2, 3], np.float32), "b": np.array([4, 5, 5, 6, 6]), "c": np.arange(1, 6)}, pg.Index(np.arange(5)))


def missing():
    return pg.DataFrame({"a": np.array([0, 1, -999, 2, -999], np.float32), "b": np.array([4, -999, -999, 6, 6])}, pg.Index(np.arange(5)))


def same(frame, data, index=None):
    found = frame.to_pandas()
    assert list(found.columns) == list(data)
    for n, values in data.items():
        wanted = np.asarray(values)
        assert found[n].to_numpy().tolist() == pytest.approx(wanted.tolist()) if wanted.dtype.kind == "f" else found[n].to_numpy().tolist() == wanted.tolist()
    if index is not None:
        assert found.index.to_numpy().tolist() == list(index)


def values(series):
    return series.values.tolist()


def test_selection_and_errors():
    df = small()
    same(df[["c", "a"]], {"c": TEXT, "a": [1.0, 2, 3, 4, 5]}, range(5))
    assert df["b"].dtype == np.int64 and df["a"].dtype == np.float32
    for bad, error in ((["a", "z"], KeyError), ("z", KeyError), ([1], TypeError), (1, TypeError), (slice(0.5, 2), ValueError)):
        with pytest.raises(error):
            df[bad]
    assert "a" in df and "z" not in df and list(df) == ["a", "b", "c"] and len(df) == 5
    assert values(df.columns) == [b"a", b"b", b"c"]
    assert df.dtypes.values.tolist()[:2] == [b"float32", b"int64"]
    assert "DataFrame" in repr(df) and "goosfraba" in str(df)


def test_filter_slice_head_tail_keep_labels():
    df = df1()
    same(df[df["a"] > 2], {"a": [3, 4], "b": [4.0, 5]}, [5, 6])
    same(df[df.index < 4], {"a": [0, 1], "b": [1.0, 2]}, [2, 3])
    same(df[(df["a"] > 0) & (df["b"] < 4) | (df["a"] == 4)], {"a": [1, 2, 4], "b": [2.0, 3, 5]}, [3, 4, 6])
    same(df[~(df["a"] != 2)], {"a": [2], "b": [3.0]}, [4])
    same(df[1:3], {"a": [1, 2], "b": [2.0, 3]}, [3, 4])
    same(df[1:], {"a": [1, 2, 3, 4], "b": [2.0, 3, 4, 5]}, [3, 4, 5, 6])
    same(df[::2], {"a": [0, 2, 4], "b": [1.0, 3, 5]}, [2, 4, 6])
    same(df[-2:], {"a": [3, 4], "b": [4.0, 5]}, [5, 6])
    same(df.head(2), {"a": [0, 1], "b": [1.0, 2]}, [2, 3])
    same(df.tail(2), {"a": [3, 4], "b": [4.0, 5]}, [5, 6])
    same(df.tail(50), {"a": [0, 1, 2, 3, 4], "b": [1.0, 2, 3, 4, 5]}, range(2, 7))
    same(df.iloc[1:3], {"a": [1, 2], "b": [2.0, 3]}, [3, 4])
    same(df.iloc[pg.Series(np.array([4, 0, 0]))], {"a": [4, 0, 0], "b": [5.0, 1, 1]}, [6, 2, 2])
    with pytest.raises(NotImplementedError):
        df.iloc[1]


def test_default_labels_survive_filters_and_sorts():
    df = pg.DataFrame({"a": np.array([5, 3, 9, 1])})
    same(df[df["a"] > 2].sort_values("a"), {"a": [3, 5, 9]}, [1, 0, 2])
    same(df.sort_values("a")[1:3].reset_index(), {"index": [1, 0], "a": [3, 5]}, [0, 1])


def test_comparisons_and_arithmetic_drop_strings():
    df = small()
    same(df < 3, {"a": [True, True, False, False, False], "b": [True, True, False, False, False]})
    same(df * 2, {"a": [2.0, 4, 6, 8, 10], "b": [2, 4, 6, 8, 10]})
    same(df * [2, 3], {"a": [2.0, 4, 6, 8, 10], "b": [3, 6, 9, 12, 15]})
    same(df / 2, {"a": [0.5, 1, 1.5, 2, 2.5], "b": [0, 1, 1, 2, 2]})
    with pytest.raises(ValueError):
        df * [1]
    for bad in (["x", 1], "x", None):
        with pytest.raises(TypeError):
            df * bad
    with pytest.raises(TypeError):
        df < "x"


def test_aggregates():
    df = small()
    wanted = {"min": [1, 1], "max": [5, 5], "sum": [15, 15], "prod": [120, 120], "count": [5, 5], "mean": [3, 3], "var": [2.5, 2.5], "std": [1.581139, 1.581139]}
    for how, row in wanted.items():
        found = getattr(df, how)()
        assert values(found) == pytest.approx(row)
        assert values(found.index) == [b"a", b"b"]
        assert found.dtype == (np.int64 if how == "count" else np.float64)
    same(df.agg(["max", "var", "count", "mean"]), {"a": [5, 2.5, 5, 3.0], "b": [5, 2.5, 5, 3.0]}, [b"max", b"var", b"count", b"mean"])
    assert values(df["b"].agg(["min", "std"])) == pytest.approx([1, 1.581139])
    assert df["a"].sum().evaluate() == 15 and df["a"].sum().dtype == np.float32
    assert df["b"].max().evaluate() == 5 and isinstance(df["b"].max().evaluate(), np.int64)
    assert df["c"].min().evaluate() == "   dC  "
    with pytest.raises(TypeError):
        df["c"].sum()
    with pytest.raises(ValueError):
        df.agg(["median"])
    with pytest.raises(TypeError):
        df.agg("min")
    assert np.isnan(pg.Series(np.array([3])).var().evaluate())
    assert df[["a", "a"]].sum().dtype == np.float32


def test_schema_operators():
    df = small()
    assert list(df.rename({"a": "x", "zz": "y"})) == ["x", "b", "c"]
    assert list(df.drop("a")) == ["b", "c"] and list(df.drop(["a", "c"])) == ["b"]
    with pytest.raises(KeyError):
        df.drop("z")
    with pytest.raises(TypeError):
        df.drop(3)
    same(df[["a", "b"]].astype(np.int16), {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4, 5]})
    assert df.astype({"a": np.int64})["a"].dtype == np.int64
    with pytest.raises(TypeError):
        df.astype(np.int64)
    same(df1().reset_index(), {"index": [2, 3, 4, 5, 6], "a": [0, 1, 2, 3, 4], "b": [1.0, 2, 3, 4, 5]}, range(5))
    same(df2().reset_index(), {"a": [1, 3, 5], "d": [b"abc", b"def", b"efgh"], "b": [3.0, 4, 5], "c": [4, 5, 6]}, range(3))
    same(df1().set_index("a"), {"b": [1.0, 2, 3, 4, 5]}, range(5))
    same(df1().set_index(["a", "b"]).reset_index(), {"a": [0, 1, 2, 3, 4], "b": [1.0, 2, 3, 4, 5]})


def test_setitem():
    df = small()
    df["d"] = np.array([5, 6, 7, 8, 9])
    df["e"] = df["b"] * 2
    df["a"] = df["b"]
    same(df[["a", "d", "e"]], {"a": [1, 2, 3, 4, 5], "d": [5, 6, 7, 8, 9], "e": [2, 4, 6, 8, 10]})
    df["x"] = pg.Series(np.array([4, 7, 5, 6, 8]), pg.Index(np.array([0, 3, 1, 2, 5])))
    same(df[["x"]], {"x": [4, 5, 6, 7, -999]}, range(5))
    df["y"] = pg.Series(np.array([4, 7, 5]), pg.Index(np.array([0, 0, 1])))
    same(df[["y"]], {"y": [7, 5, -999, -999, -999]})
    with pytest.raises(TypeError):
        df[1] = np.arange(5)
    with pytest.raises(TypeError):
        df["z"] = "text"


def test_sorting():
    df = pg.DataFrame({"a": np.array([3, 2, 0, 4, 1]), "b": np.array([1, 0, 1, 0, 1])}, pg.Index(np.array([5, 4, 2, 6, 3])))
    same(df.sort_values("a"), {"a": [0, 1, 2, 3, 4], "b": [1, 1, 0, 1, 0]}, [2, 3, 4, 5, 6])
    same(df.sort_values("a", ascending=False), {"a": [4, 3, 2, 1, 0], "b": [0, 1, 0, 1, 1]})
    same(df.sort_values("b"), {"a": [2, 4, 3, 0, 1], "b": [0, 0, 1, 1, 1]})  # ties keep their order
    same(df.sort_values(["b", "a"], ascending=[True, False]), {"a": [4, 2, 3, 1, 0], "b": [0, 0, 1, 1, 1]})
    same(df.sort_index(), {"a": [0, 1, 2, 3, 4], "b": [1, 1, 0, 1, 0]}, [2, 3, 4, 5, 6])
    same(df.sort_index(ascending=False), {"a": [4, 3, 2, 1, 0], "b": [0, 1, 0, 1, 1]}, [6, 5, 4, 3, 2])
    with pytest.raises(KeyError):
        df.sort_values("z")


GROUPS = {
    "sum": ([0, 2, 5], [1, 5, 9]),
    "mean": ([0, 1, 2.5], [1, 2.5, 4.5]),
    "var": ([0, 0, 0.5], [0, 0.5, 0.5]),
    "std": ([0, 0, 0.70711], [0, 0.70711, 0.70711]),
    "size": ([1, 2, 2], [1, 2, 2]),
    "min": ([0, 1, 2], [1, 2, 4]),
    "max": ([0, 1, 3], [1, 3, 5]),
    "prod": ([0, 1, 6], [1, 6, 20]),
}


@pytest.mark.parametrize("how", GROUPS)
def test_groups(how):
    found = getattr(duplicated().groupby("b"), how)().to_pandas()
    assert found.index.tolist() == [4, 5, 6] and found.index.name == "b"
    assert found["a"].tolist() == pytest.approx(GROUPS[how][0], abs=1e-4) and found["c"].tolist() == pytest.approx(GROUPS[how][1], abs=1e-4)


def test_groups_of_several_keys_and_errors():
    found = duplicated().groupby(["a", "b"]).min().to_pandas()
    assert found.index.tolist() == [(0, 4), (1, 5), (2, 6), (3, 6)] and found["c"].tolist() == [1, 2, 4, 5]
    three = pg.DataFrame({"k": np.array([1, 1, 1]), "v": np.array([4, 6, 11])})
    assert three.groupby("k").var().to_pandas()["v"].tolist() == [13.0]  # over n - 1
    with pytest.raises(ValueError):
        duplicated().groupby(["a", "b", "c"])
    with pytest.raises(TypeError):
        duplicated().groupby(1)
    with pytest.raises(KeyError):
        duplicated().groupby("z")


def test_duplicates():
    same(duplicated()[["a", "b"]].drop_duplicates(), {"a": [0.0, 1, 2, 3], "b": [4, 5, 6, 6]}, [0, 1, 3, 4])
    same(duplicated()[["a", "b"]].drop_duplicates(["b"]), {"a": [0.0, 1, 2], "b": [4, 5, 6]}, [0, 1, 3])
    same(duplicated().drop_duplicates(["b"], keep="max"), {"a": [0.0, 1, 3], "b": [4, 5, 6], "c": [1, 3, 5]}, [0, 2, 4])
    same(duplicated().drop_duplicates(["b"], keep="+")[["a", "c"]], {"a": [0.0, 2, 5], "c": [1, 5, 9]})
    same(duplicated().drop_duplicates(["b"], keep="*")[["a", "c"]].sort_values("c"), {"a": [0.0, 1, 6], "c": [1, 6, 20]})
    with pytest.raises(ValueError):
        duplicated().drop_duplicates(keep="first")
    with pytest.raises(ValueError):
        duplicated().drop_duplicates([])


N, M = b"None", -999
JOINS = {
    "inner": ([1, 3], {"index": [3, 5], "b_x": [2.0, 4], "d": [b"abc", b"def"], "b_y": [3.0, 4], "c": [4, 5]}),
    "left": (range(5), {"index": [2, 3, 4, 5, 6], "b_x": [1.0, 2, 3, 4, 5], "d": [N, b"abc", N, b"def", N], "b_y": [M, 3.0, M, 4, M], "c": [M, 4, M, 5, M]}),
    "right": ([1, 3, 5], {"index": [3, 5, M], "b_x": [2.0, 4, M], "d": [b"abc", b"def", b"efgh"], "b_y": [3.0, 4, 5], "c": [4, 5, 6]}),
    "outer": (range(6), {"index": [2, 3, 4, 5, 6, M], "b_x": [1.0, 2, 3, 4, 5, M], "d": [N, b"abc", N, b"def", N, b"efgh"], "b_y": [M, 3.0, M, 4, M, 5], "c": [M, 4, M, 5, M, 6]}),
}


@pytest.mark.parametrize("algorithm", ["merge", "hash"])
@pytest.mark.parametrize("how", JOINS)
def test_joins(how, algorithm):
    index, data = JOINS[how]
    same(df1().merge(df2(), how=how, on="a", algorithm=algorithm), data, index)


def test_joins_of_several_keys_unsorted_and_errors():
    found = df1().merge(df2(), on=["a", "b"]).to_pandas()
    assert found.index.tolist() == [(3, 4.0)] and found["index"].tolist() == [5] and found["d"].tolist() == [b"def"] and found["c"].tolist() == [5]
    left = pg.DataFrame({"a": np.array([3, 2, 0, 4, 1]), "b": np.array([4, 3, 1, 5, 2], np.float32)}, pg.Index(np.array([5, 4, 2, 6, 3])))
    same(left.merge(df2(), on="a"), JOINS["inner"][1], [1, 3])
    many = pg.DataFrame({"a": np.array([1, 1, 2]), "v": np.array([5, 6, 7])})
    assert sorted(many.merge(many, on="a").to_pandas()["v_x"].tolist()) == [5, 5, 6, 6, 7]  # keys may repeat
    a = pg.DataFrame({"x": np.array([1, 2])}, pg.Index(np.array([7, 8]), name="k"))
    b = pg.DataFrame({"y": np.array([3])}, pg.Index(np.array([8]), name="k"))
    same(a.join(b), {"x": [1, 2], "y": [-999, 3]}, [7, 8])
    same(a.merge(b), {"x": [2], "y": [3]}, [8])
    same(a.join(a, lsuffix="_l", rsuffix="_r"), {"x_l": [1, 2], "x_r": [1, 2]})
    for bad, error in (({"how": "cross"}, ValueError), ({"algorithm": "nested"}, NotImplementedError), ({"on": 3}, TypeError), ({"on": "zz"}, KeyError)):
        with pytest.raises(error):
            df1().merge(df2(), **{"on": "a", **bad})
    with pytest.raises(ValueError):
        df1().merge(df2())
    with pytest.raises(ValueError):
        a.join(a)


def test_missing_data():
    df = missing()
    same(df.isna(), {"a": [False, False, True, False, True], "b": [False, True, True, False, False]})
    same(df.notna(), {"a": [True, True, False, True, False], "b": [True, False, False, True, True]})
    same(df.dropna(), {"a": [0.0, 2], "b": [4, 6]}, [0, 3])
    same(df.dropna(["a"]), {"a": [0.0, 1, 2], "b": [4, -999, 6]}, [0, 1, 3])
    same(df.fillna(15), {"a": [0.0, 1, 15, 2, 15], "b": [4, 15, 15, 6, 6]})
    same(df.fillna({"a": 15}), {"a": [0.0, 1, 15, 2, 15], "b": [4, -999, -999, 6, 6]})
    assert values(pg.Series(np.array([b"a", b"None"])).fillna("z")) == [b"a", b"z"]
    assert len(pg.Series(np.array([True, False])).dropna()) == 2  # False is not missing
    for bad in ([], ["z"]):
        with pytest.raises(ValueError):
            df.dropna(bad)
    with pytest.raises(TypeError):
        df.fillna([1])


def test_missing_data_as_nulls():
    with pg.missing_as("null"):
        joined = df1().merge(df2(), how="left", on="a")
        assert joined["c"].isna().values.tolist() == [True, False, True, False, True]
        assert joined["c"].dropna().sum().evaluate() == 9 and joined["c"].sum().evaluate() == 9
        assert joined["d"].fillna("x").values.tolist() == [b"x", b"abc", b"x", b"def", b"x"]
        assert missing()["b"].isna().values.tolist() == [False] * 5
    with pytest.raises(ValueError), pg.missing_as("nan"):
        pass


def test_empty_frames():
    empty = pg.DataFrame({}, pg.Index(np.arange(0)))
    assert empty.empty and len(empty) == 0 and values(empty.min()) == []
    with pytest.raises(ValueError):
        empty.agg(["min"])
    with pytest.raises(KeyError):
        empty.drop("a")
    assert pg.DataFrame().empty
    assert pg.Series([]).dtype == np.float64 and len(pg.Series([])) == 0
    for bad in ([1], {"a": "x"}, {1: np.arange(2)}):
        with pytest.raises(TypeError):
            pg.DataFrame(bad)
    with pytest.raises(ValueError):
        pg.DataFrame({"a": np.arange(2), "b": np.arange(3)})


def test_pandas_and_back():
    frame = pd.DataFrame({"a": [1, 2], "s": ["x", "é"]}, index=pd.MultiIndex.from_tuples([(1, "p"), (2, "q")], names=["i", "j"]))
    back = pg.DataFrame.from_pandas(frame).to_pandas()
    assert back["a"].tolist() == [1, 2] and back["s"].tolist() == [b"x", "é".encode()] and back.index.tolist() == [(1, b"p"), (2, b"q")] and back.index.names == ["i", "j"]
    series = pd.Series([1.5, 2.5], index=[4, 5], name="v")
    pd.testing.assert_series_equal(pg.Series.from_pandas(series).to_pandas(), series)
    assert pg.Index.from_pandas(pd.RangeIndex(2, 8, 3)).to_pandas().tolist() == [2, 5]


def test_evaluate_keeps_rows():
    df = df1()
    kept = df[df["a"] > 2].evaluate()
    same(kept, {"a": [3, 4], "b": [4.0, 5]}, [5, 6])
    assert values(kept["a"] + kept["a"]) == [6, 8]


def test_files(tmp_path):
    df = df1()
    df.to_csv(f"{tmp_path}/x", single_file=True)
    back = pg.read_csv(f"{tmp_path}/x")
    assert list(back) == ["index", "a", "b"] and back["a"].dtype == np.int64
    same(back[["a"]], {"a": [0, 1, 2, 3, 4]})
    (tmp_path / "y.csv").write_text("skip me\n,a,b\n2,0,1.5\n3,1,2.5\n4,2,3.5\n")
    path = str(tmp_path / "y.csv")
    same(pg.read_csv(path, skiprows=1), {"Unnamed: 0": [2, 3, 4], "a": [0, 1, 2], "b": [1.5, 2.5, 3.5]})
    same(pg.read_csv(path, skiprows=2, header=None, names=["i", "a", "b"], usecols=["a", "b"], dtype={"a": np.float64}, nrows=2, converters={"b": lambda c: c * 2}), {"a": [0.0, 1], "b": [3.0, 5]})
    with pytest.raises(ValueError):
        pg.read_csv(path, skiprows=1, usecols=["zz"])
    df.to_parquet(f"{tmp_path}/z", index=True)
    same(pg.read_parquet(f"{tmp_path}/z").sort_values("a")[["index", "a"]], {"index": [2, 3, 4, 5, 6], "a": [0, 1, 2, 3, 4]})
