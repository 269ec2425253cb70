import ctypes.util

import numpy as np
import pandas as pd
import pytest

import pelagos as pg
from pelagos import types as t

pytestmark = pytest.mark.usefixtures("spark")
TEXT = np.array([b"a", b"Abc", b"goosfraba", b"   dC  ", b"secrETariat"])


def floats():
    return pg.Series(np.arange(1, 6, dtype=np.float32), pg.Index(np.arange(5)))


def test_construction_and_names():
    s = pg.Series([1, 2, 3], dtype=np.float64, name="x")
    assert s.dtype == np.float64 and s.name == "x" and s.values.tolist() == [1.0, 2.0, 3.0]
    s.name = "y"
    assert s.to_pandas().name == "y"
    for bad in (3, {1: 2}, [[1], [2]], [1j], np.array([{}])):
        with pytest.raises(TypeError):
            pg.Series(bad)
    assert "float32" in repr(floats())


def test_comparisons_with_scalars_only():
    s = floats()
    for op, wanted in (("__lt__", [1, 0, 0, 0, 0]), ("__le__", [1, 1, 0, 0, 0]), ("__eq__", [0, 1, 0, 0, 0]), ("__ne__", [1, 0, 1, 1, 1]), ("__ge__", [0, 1, 1, 1, 1]), ("__gt__", [0, 0, 1, 1, 1])):
        assert getattr(s, op)(2).values.tolist() == [bool(x) for x in wanted]
    assert (pg.Series(TEXT) != "Abc").values.tolist() == [True, False, True, True, True]
    assert (pg.Series(TEXT) == b"Abc").values.tolist() == [False, True, False, False, False]
    assert (pg.Series([1, 2]) < 2.0).values.tolist() == [True, False]
    for bad in (s, np.arange(5), [1]):
        with pytest.raises(TypeError):
            s < bad
    with pytest.raises(TypeError):
        s < "x"
    with pytest.raises(TypeError):
        pg.Series(TEXT) < 3


def test_arithmetic_keeps_the_dtype():
    s = floats()
    two = pg.Series(np.full(5, 2, np.float32))
    for op, wanted in (("+", [3, 4, 5, 6, 7]), ("-", [-1, 0, 1, 2, 3]), ("*", [2, 4, 6, 8, 10]), ("/", [0.5, 1, 1.5, 2, 2.5]), ("**", [1, 4, 9, 16, 25])):
        for other in (two, 2):
            found = eval(f"s {op} other")
            assert found.values.tolist() == wanted and found.dtype == np.float32
            assert found.index.values.tolist() == [0, 1, 2, 3, 4]
    small = pg.Series(np.array([7, -7, 8], np.int16))
    assert (small / 2).values.tolist() == [3, -3, 4] and (small / 2).dtype == np.int16
    assert (10 - small).values.tolist() == [3, 17, 2]
    assert (pg.Series([1.0, -1.0, 0.0]) / 0).values.tolist()[:2] == [np.inf, -np.inf]
    assert np.isnan((pg.Series([0.0]) / 0).values[0])
    for bad in (pg.Series(np.arange(5)), "x", None):
        with pytest.raises(TypeError):
            s + bad
    with pytest.raises(TypeError):
        pg.Series(TEXT) + 1


def test_positional_arithmetic_keeps_the_left_labels():
    a = pg.Series(np.array([1, 2, 3]), pg.Index(np.array([7, 8, 9])))
    b = pg.Series(np.array([10, 20, 30]), pg.Index(np.array([0, 1, 2])))
    found = a + b
    assert found.values.tolist() == [11, 22, 33] and found.index.values.tolist() == [7, 8, 9]
    assert (a.head(2) + a.tail(2)).values.tolist() == [3, 5]


def test_logic_filter_slices_positions():
    s = floats()
    assert s[(s > 1) & (s < 4)].values.tolist() == [2, 3]
    assert s[(s < 2) | (s > 4)].index.values.tolist() == [0, 4]
    assert (~(s > 2)).values.tolist() == [True, True, False, False, False]
    with pytest.raises(TypeError):
        s & s
    assert s[1:3].values.tolist() == [2, 3] and s[::2].values.tolist() == [1, 3, 5] and s[-1:].values.tolist() == [5]
    assert s.iloc[2].evaluate() == 3 and s.iloc[-1].evaluate() == 5
    with pytest.raises(IndexError):
        s.iloc[9].evaluate()
    assert s.iloc[np.array([0, 3, 3])].values.tolist() == [1, 4, 4]
    found = s._iloc(pg.Series(np.array([0, 3, 5])), missing=True)
    assert found.values.tolist() == [1, 4, -999] and found.index.values.tolist() == [0, 3, -999]
    assert s.head(2).values.tolist() == [1, 2] and s.tail(2).values.tolist() == [4, 5]


def test_positions_over_large_slices(spark):
    s = pg.DataFrame.from_spark(spark.range(30_000).selectExpr("(id * 7919) % 30000 AS v"))["v"]
    ordered = pg.DataFrame({"v": s}).sort_values("v")["v"]
    assert ordered[12_345:12_348].values.tolist() == [12_345, 12_346, 12_347]
    assert ordered.head(20_000).tail(1).values.tolist() == [19_999]
    assert ordered[29_990:].values.tolist() == list(range(29_990, 30_000))
    down = pg.DataFrame({"v": s}).sort_values("v", ascending=False)["v"]
    assert down[15_000:15_002].values.tolist() == [14_999, 14_998]
    tied = pg.DataFrame.from_spark(spark.range(5000).selectExpr("id % 3 AS k", "id AS v"), order_by=["v"]).sort_values("k")
    assert tied[1666:1669]["v"].values.tolist() == [4998, 1, 4]


def test_missing_unique_astype():
    s = pg.Series(np.array([1, -999, 3]))
    assert s.isna().values.tolist() == [False, True, False] and s.notna().values.tolist() == [True, False, True]
    assert s.dropna().index.values.tolist() == [0, 2] and s.fillna(7).values.tolist() == [1, 7, 3]
    assert sorted(pg.Series(np.array([3, 1, 3])).unique().values.tolist()) == [1, 3]
    assert floats().astype(np.int64).values.tolist() == [1, 2, 3, 4, 5]
    with pytest.raises(TypeError):
        pg.Series(TEXT).astype(np.int64)


STRINGS = {
    "lower()": [b"a", b"abc", b"goosfraba", b"   dc  ", b"secretariat"],
    "upper()": [b"A", b"ABC", b"GOOSFRABA", b"   DC  ", b"SECRETARIAT"],
    "capitalize()": [b"A", b"Abc", b"Goosfraba", b"   dc  ", b"Secretariat"],
    "get(1)": [b"None", b"b", b"o", b" ", b"e"],
    "get(0)": [b"a", b"A", b"g", b" ", b"s"],
    "get(-2)": [b"None", b"b", b"b", b" ", b"a"],
    "strip()": [b"a", b"Abc", b"goosfraba", b"dC", b"secrETariat"],
    "slice(0, 3)": [b"a", b"Abc", b"goo", b"   ", b"sec"],
    "slice(1, 6, 2)": [b"", b"b", b"osr", b" d ", b"erT"],
    "slice(-2)": [b"a", b"bc", b"ba", b"  ", b"at"],
    "contains('r')": [False, False, True, False, True],
    "contains('')": [True] * 5,
    "startswith('a')": [True, False, False, False, False],
    "endswith('a')": [True, False, True, False, False],
    "find('a')": [0, -1, 6, -1, 6],
    "find('a', 7)": [-1, -1, 8, -1, 9],
    "find('a', 3, 7)": [-1, -1, 6, -1, 6],
    "replace('a', 'XX')": [b"XX", b"Abc", b"goosfrXXba", b"   dC  ", b"secrETXXriat"],
    "split('a', 'left')": [b"", b"Abc", b"goosfr", b"   dC  ", b"secrET"],
    "split('a', 'right')": [b"", b"Abc", b"ba", b"   dC  ", b"riat"],
}


@pytest.mark.parametrize("call", STRINGS)
def test_strings(call):
    found = eval(f"pg.Series(TEXT).str.{call}")
    assert found.values.tolist() == STRINGS[call]


def test_string_errors():
    s = pg.Series(TEXT).str
    for call, error in (("split('a', 'up')", ValueError), ("find('a', 3, 3)", ValueError), ("slice(0, 3, -1)", ValueError), ("get('x')", TypeError), ("contains(3)", TypeError)):
        with pytest.raises(error):
            eval(f"s.{call}")
    with pytest.raises(AttributeError):
        floats().str


def test_lower_is_ascii_only():
    assert pg.Series(np.array(["ÀB".encode()])).str.lower().values.tolist() == ["Àb".encode()]


@pytest.mark.parametrize("name", ["exp", "log", "sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "erf"])
def test_unary_functions(name):
    import math

    x = np.array([0.1, 0.5, 0.9])
    found = pg.Series(x).apply(getattr(pg, name))
    assert found.values == pytest.approx([getattr(math, name)(v) for v in x])
    assert pg.Series(x.astype(np.float32)).apply(getattr(pg, name)).dtype == np.float32
    with pytest.raises(TypeError):
        pg.Series(np.array([1])).apply(getattr(pg, name))


def test_log_of_zero_and_below():
    found = pg.Series([0.0, -1.0]).apply(pg.log).values
    assert found[0] == -np.inf and np.isnan(found[1])


def test_functions_of_the_user():
    s = floats()
    assert s.apply("{self} + {k}", mapping={"k": 2}).values.tolist() == [3, 4, 5, 6, 7]
    assert s.apply("{self} > {k}", mapping={"k": 2.5}, new_dtype=bool).values.tolist() == [False, False, True, True, True]
    assert s.apply("{self} * {o}", mapping={"o": s}).values.tolist() == [1, 4, 9, 16, 25]
    assert s.apply(lambda c, k: c * k, k=3).values.tolist() == [3, 6, 9, 12, 15]
    assert s.apply(pg.raw(np.sqrt)).values == pytest.approx(np.sqrt(np.arange(1, 6)))
    assert s.apply(pg.raw(lambda a: a[::-1], whole=True)).values.tolist() == [5, 4, 3, 2, 1]
    unsorted = pg.Series(np.array([5, 2, 3, 1, 4], np.float32), pg.Index(np.arange(5)))
    assert unsorted.apply(pg.sort).values.tolist() == [1, 2, 3, 4, 5] and unsorted.apply(pg.sort).index.values.tolist() == [0, 1, 2, 3, 4]
    assert pg.sort(np.array([2, 1])).tolist() == [1, 2]
    with pytest.raises(TypeError):
        pg.raw(np.sqrt)(s)
    with pytest.raises(TypeError):
        s.apply(3)


@pytest.mark.skipif(not ctypes.util.find_library("m"), reason="no C library")
def test_functions_of_c_libraries():
    name = pg.load_cudf(ctypes.util.find_library("m"), "hypot", [np.float64, np.float64], np.float64)
    assert pg.Series([3.0, 5.0]).apply(name + "({self}, {k})", mapping={"k": 4.0}).values == pytest.approx(np.hypot([3, 5], 4))
    with pytest.raises(TypeError):
        pg.load_cudf("x", "f", [str], np.float64)


def test_indexes():
    ind = pg.Index(np.arange(5), name="n")
    assert ind[ind > 2].values.tolist() == [3, 4] and ind[1:3].values.tolist() == [1, 2]
    assert (ind + pg.Series(np.arange(5))).values.tolist() == [0, 2, 4, 6, 8]
    assert ind.max().evaluate() == 4 and ind.astype(np.float64).dtype == np.float64 and ind.to_pandas().name == "n"
    ri = pg.RangeIndex(5)
    assert (ri / 2).values.tolist() == [0, 0, 1, 1, 2] and len(ri) == 5 and pg.RangeIndex(1, 9, 3).values.tolist() == [1, 4, 7]
    assert (ri < 3).values.tolist() == [True, True, True, False, False]
    assert ri.isna().values.tolist() == [False] * 5 and ri.dropna().values.tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(TypeError):
        ri < 2.5
    with pytest.raises(ValueError):
        pg.RangeIndex(0, 5, -1)
    with pytest.raises(ValueError):
        pg.RangeIndex()
    mi = pg.MultiIndex([np.array([0, -999, 2, -999]), np.array([1, -999, -999, 3])], ["a", "b"])
    assert mi.dropna().to_pandas().tolist() == [(0, 1)] and mi.names == ["a", "b"] and len(mi) == 4
    assert mi[1:3].to_pandas().tolist() == [(-999, -999), (2, -999)] and mi.tail(1).to_pandas().tolist() == [(-999, 3)]
    assert mi[pg.Series(np.array([True, False, False, True]))].to_pandas().tolist() == [(0, 1), (-999, 3)]
    assert pg.MultiIndex.from_pandas(pd.MultiIndex.from_tuples([(1, "x")])).to_pandas().tolist() == [(1, b"x")]
    with pytest.raises(TypeError):
        pg.MultiIndex(3)


def test_types():
    assert t.dtype_of("int64") == np.int64 and t.dtype_of(str) == t.STRING
    with pytest.raises(TypeError):
        t.dtype_of(np.complex128)


@pytest.mark.parametrize("seed", range(3))
def test_random_frames_against_pandas(seed):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"k": rng.integers(0, 5, 60), "v": rng.integers(-50, 50, 60), "x": rng.random(60).round(3)}, index=rng.permutation(60))
    df = pg.DataFrame.from_pandas(frame)
    a, b = sorted(rng.integers(0, 60, 2))
    pd.testing.assert_frame_equal(df[df["v"] > 0][int(a) // 4 : int(b)].to_pandas(), frame[frame.v > 0][a // 4 : b])
    pd.testing.assert_frame_equal(df.sort_values(["k", "v"]).iloc[int(a) : int(b)].to_pandas(), frame.sort_values(["k", "v"], kind="stable")[a:b], check_names=False)
    pd.testing.assert_frame_equal(df.groupby("k").sum().to_pandas(), frame.groupby("k").sum())
    pd.testing.assert_frame_equal(df.groupby("k").var().to_pandas(), frame.groupby("k").var())
    pd.testing.assert_frame_equal(df.sort_index().tail(7).to_pandas(), frame.sort_index().tail(7))
