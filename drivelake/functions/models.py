"""Parametric models: value, time derivative and fit, as native expressions wherever there is one.

Time s is normalised: 0 at an activity's start, 1 at its end; other values extrapolate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Every parameter that some model has; an activity's `parameters` is JSON with those of its model.
PARAMETERS = "struct<xstart:double,xend:double,a1:double,b1:double,c1:double,d1:double,a2:double,b2:double,c2:double,d2:double,knots:array<double>,coefficients:array<double>,degree:int>"
VECTOR_PARAMETERS = "struct<xstart:array<double>,knots:array<array<double>>,coefficients:array<array<double>>,degree:array<int>>"
MESSAGE_PARAMETERS = "struct<message_name:string,message:string,frequency:double,receive:boolean,network:string,network_quality:string>"


def _spline_value(knots: Column, coefficients: Column, degree: Column, s: Column) -> Column:
    """de Boor's recursion over arrays; beyond the ends the outer pieces go on. Coefficients beyond the basis are ignored."""
    n = F.size(knots) - degree - 1
    inner = F.size(F.filter(knots, lambda t, i: (i > degree) & (i < n) & (t <= s)))
    k = F.least(F.greatest(degree + inner, degree), n - 1)
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    start = F.transform(F.sequence(F.lit(0), degree), lambda j: at(coefficients, j + k - degree))

    def step(d: Column, r: Column) -> Column:
        def blend(j: Column) -> Column:
            lo, hi = at(knots, j + k - degree), at(knots, j + 1 + k - r)
            w = F.when(hi == lo, F.lit(0.0)).otherwise((s - lo) / (hi - lo))
            return F.when(j < r, at(d, j)).otherwise((1 - w) * at(d, j - 1) + w * at(d, j))

        return F.transform(F.sequence(F.lit(0), degree), blend)

    rounds = F.filter(F.sequence(F.lit(0), degree), lambda r: r >= 1)
    return at(F.aggregate(rounds, start, step), degree)


def _spline_slope(knots: Column, coefficients: Column, degree: Column, s: Column) -> Column:
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    n = F.size(knots) - degree - 1
    gap = lambda i: at(knots, i + degree + 1) - at(knots, i + 1)
    slopes = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.when(gap(i) == 0, F.lit(0.0)).otherwise(degree * (at(coefficients, i + 1) - at(coefficients, i)) / gap(i)))
    return F.when(degree < 1, F.lit(0.0)).otherwise(_spline_value(F.slice(knots, F.lit(2), F.size(knots) - 2), slopes, degree - 1, s))


#: A spline as one polynomial for each interval between knots: starts has where the intervals begin, c their coefficients in powers of
#: the distance from there, the highest first, d those of the derivative.
PIECES = "struct<starts:array<double>,c:array<array<double>>,d:array<array<double>>>"


def power_form(knots: np.ndarray, coefficients: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, c and d (see PIECES) of a B-spline."""
    starts, c, d = power_forms(knots, np.asarray(coefficients, float)[None], degree)
    return starts, c[0], d[0]


def power_forms(knots: np.ndarray, coefficients: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, and c and d (see PIECES) of each of many B-splines on the same knots, a row of coefficients each. The derivative
    of a spline is one of the coefficients' differences, and c has its values at each start over the factorials. Coefficients
    beyond the basis are ignored; an interval without length, which no value falls in, has zeros."""
    n = len(knots) - degree - 1
    at = np.arange(degree, n)
    t, w, factorial = knots, coefficients[:, :n], 1.0
    c = np.zeros((len(w), len(at), degree + 1))
    long = knots[at + 1] > knots[at]
    for k in range(degree + 1):
        if k:
            m = w.shape[1]
            gap = t[degree - k + 2 : degree - k + 2 + m - 1] - t[1:m]
            w = np.where(gap > 0, (degree - k + 1) * (w[:, 1:] - w[:, :-1]) / np.where(gap > 0, gap, 1), 0)
            t, factorial = t[1:-1], factorial * k
        p = degree - k
        # de Boor's triangle at the start of each interval, for all of them at once.
        d = np.stack([w[:, at - k - p + j] for j in range(p + 1)], 2)
        for r in range(1, p + 1):
            for j in range(p, r - 1, -1):
                lo, hi = t[at - k + j - p], t[at - k + 1 + j - r]
                a = np.where(hi > lo, (knots[at] - lo) / np.where(hi > lo, hi - lo, 1), 0)
                d[:, :, j] = (1 - a) * d[:, :, j - 1] + a * d[:, :, j]
        c[:, :, degree - k] = np.where(long, d[:, :, p] / factorial, 0)
    return knots[at], c, c[:, :, :-1] * np.arange(degree, 0, -1) if degree else np.zeros((len(c), len(at), 1))


def _lists(values: pa.Array, size: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size), pa.int32()), values)


def _pieces_of(knots: pa.Array, coefficients: pa.Array, degree: pa.Array) -> pa.Array:
    """PIECES of each row's B-spline, null where a parameter is. Those on the same knots are put in powers together, and Arrow takes
    their numbers as they lie."""
    kind = pa.struct([("starts", pa.list_(pa.float64())), ("c", pa.list_(pa.list_(pa.float64()))), ("d", pa.list_(pa.list_(pa.float64())))])
    ok = np.flatnonzero((knots.is_valid().to_numpy(False) & coefficients.is_valid().to_numpy(False) & degree.is_valid().to_numpy(False)).astype(bool))
    if not len(ok):
        return pa.nulls(len(knots), kind)
    kt, kv = knots.offsets.to_numpy(), knots.values.to_numpy(False).astype(float)
    ct, cv = coefficients.offsets.to_numpy(), coefficients.values.to_numpy(False).astype(float)
    grouped: dict = {}
    for i, p in zip(ok.tolist(), degree.take(pa.array(ok)).to_pylist()):
        grouped.setdefault((kv[kt[i] : kt[i + 1]].tobytes(), p), []).append(i)
    found, place, done = [], np.full(len(knots), -1), 0
    for (raw, p), rows in grouped.items():
        t, rows = np.frombuffer(raw), np.array(rows)
        n = len(t) - p - 1
        starts, c, d = power_forms(t, cv[ct[rows][:, None] + np.arange(n)], p)
        k = len(starts)
        some = [_lists(pa.array(np.tile(starts, len(rows))), k), *(_lists(_lists(pa.array(x.reshape(-1)), x.shape[2]), k) for x in (c, d))]
        found.append(pa.StructArray.from_arrays(some, fields=list(kind)))
        place[rows] = np.arange(done, done + len(rows))
        done += len(rows)
    return pa.concat_arrays(found).take(pa.array(place, mask=place < 0))


def piece_value(pieces: Column, s: Column, slope: bool = False) -> Column:
    """The value, or slope, at s: the interval by its start, the outer ones going on beyond the ends, then Horner's rule."""
    k = F.greatest(F.size(F.filter(pieces["starts"], lambda t: t <= s)), F.lit(1))
    start, c = F.element_at(pieces["starts"], k), F.element_at(pieces["d" if slope else "c"], k)
    return F.aggregate(c, F.lit(0.0), lambda sum_, x: sum_ * (s - start) + x)


def with_pieces(df: DataFrame, p: str = "p") -> DataFrame:
    """df with `pieces`, the PIECES of the splines in its struct of parameters p, or null for other models."""
    return df.withColumn("pieces", F.arrow_udf(_spline_pieces, PIECES)(F.col(f"{p}.knots"), F.col(f"{p}.coefficients"), F.col(f"{p}.degree")))


def _spline_pieces(knots: pa.Array, coefficients: pa.Array, degree: pa.Array) -> pa.Array:
    return _pieces_of(knots, coefficients, degree)


def with_multi_pieces(df: DataFrame, p: str = "p") -> DataFrame:
    """df with `pieces`, an array with the PIECES of each component of a vector model."""
    return df.withColumn("pieces", F.arrow_udf(_multi_pieces, f"array<{PIECES}>")(F.col(f"{p}.knots"), F.col(f"{p}.coefficients"), F.col(f"{p}.degree")))


def _multi_pieces(knots: pa.Array, coefficients: pa.Array, degree: pa.Array) -> pa.Array:
    """An array over each row's components; as many as the shortest of its three parameters has."""
    ok = knots.is_valid().to_numpy(False).astype(bool) & coefficients.is_valid().to_numpy(False).astype(bool) & degree.is_valid().to_numpy(False).astype(bool)
    own = [x.offsets.to_numpy() for x in (knots, coefficients, degree)]
    size = np.where(ok, np.minimum.reduce([x[1:] - x[:-1] for x in own]), 0)
    bounds = np.r_[0, np.cumsum(size)]
    inner = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    each = [x.values.take(pa.array(np.repeat(o[:-1], size) + inner)) for x, o in zip((knots, coefficients, degree), own)]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _pieces_of(*each), mask=pa.array(~ok))


def _cubic(p: Column, side: str, s: Column) -> Column:
    return ((p[f"a{side}"] * s + p[f"b{side}"]) * s + p[f"c{side}"]) * s + p[f"d{side}"]


def _cubic_slope(p: Column, side: str, s: Column) -> Column:
    return (3 * p[f"a{side}"] * s + 2 * p[f"b{side}"]) * s + p[f"c{side}"]


@dataclass(frozen=True)
class Model:
    """state and dot take the struct of parameters and s; fit takes a frame, its keys and the names of time and value."""

    name: str
    state: Callable[[Column, Column], Column] | None = None
    dot: Callable[[Column, Column], Column] | None = None
    fit: Callable[..., DataFrame] | None = None
    options: tuple[str, ...] = ()
    #: Whether its p has knots, coefficients and degree, and can be evaluated by PIECES.
    piecewise: bool = False


MODELS: dict[str, Model] = {}


def register(model: Model) -> Model:
    """Adds a model of one's own; evaluation and fitting then know it by name."""
    MODELS[model.name] = model
    return model


def value(modelname: Column, p: Column, s: Column, pieces: Column | None = None) -> Column:
    """The state at s of a model with parameters p. pieces (see with_pieces) stand for splines' knots where they are at hand."""
    return _dispatch(modelname, lambda m: m.state, p, s, pieces)


def derivative(modelname: Column, p: Column, s: Column, pieces: Column | None = None) -> Column:
    return _dispatch(modelname, lambda m: m.dot, p, s, pieces)


def _dispatch(modelname: Column, of, p: Column, s: Column, pieces: Column | None = None) -> Column:
    out = None
    for name, m in MODELS.items():
        if of(m):
            v = piece_value(pieces, s, of(m) is m.dot) if m.piecewise and pieces is not None else of(m)(p, s)
            out = (F if out is None else out).when(modelname == name, v)
    return out.when(modelname.isNotNull(), F.raise_error(F.concat(F.lit("no scalar state of a model named "), modelname)).cast("double"))


# Fits. y over t for each group of keys; x is a regressor made from t. Groups with one distinct instant get the mean. The
# moments are central ones, as sums of squares of times since some epoch would lose their digits.


def _ols(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    own = df.withColumns({"_x": x, "_y": y})
    g = own.groupBy(*keys).agg(F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.covar_pop("_x", "_y").alias("sxy"), F.var_pop("_x").alias("sxx"), F.min("t_fit").alias("t0"), F.max("t_fit").alias("t1"))
    slope = F.when(F.col("t0") == F.col("t1"), F.lit(0.0)).otherwise(F.col("sxy") / F.when(F.col("sxx") != 0, F.col("sxx")))
    return g.withColumn("slope", slope).withColumn("icpt", F.col("my") - F.col("slope") * F.col("mx"))


def fit_constant(df: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(y).alias("xstart"))


def fit_linear(df: DataFrame, keys: list[str], t: str = "t", y: str = "y", endpoints: bool = False) -> DataFrame:
    """xstart, xend: the fitted line at the least and the greatest t, or there the values themselves (first of ties)."""
    if endpoints:
        return df.groupBy(*keys).agg(F.min_by(y, F.struct(t, y)).alias("xstart"), F.max_by(y, F.struct(F.col(t), -F.col(y))).alias("xend"))
    g = _ols(df.withColumn("t_fit", F.col(t)), keys, F.col(t), F.col(y))
    return g.select(*keys, (F.col("slope") * F.col("t0") + F.col("icpt")).alias("xstart"), (F.col("slope") * F.col("t1") + F.col("icpt")).alias("xend"))


def normalised(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """df with s: t from 0 at a group's least to 1 at its greatest; null where there is one instant. The bounds come by an
    aggregate and a join, so no group has to be sorted in one task."""
    bounds = df.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    return df.join(bounds, keys).withColumn("s", (F.col(t) - F.col("_t0")) / F.when(F.col("_t1") > F.col("_t0"), F.col("_t1") - F.col("_t0"))).drop("_t0", "_t1")


def fit_sinusoidal(df: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    own = normalised(df, keys, t).withColumn("t_fit", F.col(t))
    g = _ols(own, keys, F.cos(F.pi() * F.col("s")), F.col(y))
    one = F.col("t0") == F.col("t1")
    return g.select(*keys, F.when(~one, F.col("icpt") + F.col("slope")).alias("xstart"), F.when(~one, F.col("icpt") - F.col("slope")).alias("xend"))


_HALF = "abcd"


def fit_spline3knots(df: DataFrame, keys: list[str], t: str = "t", y: str = "y", endpoints: bool = False) -> DataFrame:
    """Least squares over two cubics that meet at 1/2 with equal slope and curvature: the span of 1, s, s^2, s^3 and
    max(s - 1/2, 0)^3. The normal equations' sums are native aggregates; only the 5 by 5 systems are solved in Python."""
    s, o = F.col("s"), F.greatest(F.col("s") - 0.5, F.lit(0.0))
    basis = [F.lit(1.0), s, s * s, s * s * s, o * o * o]
    own = normalised(df, keys, t).withColumn("_y", F.col(y))
    sums = [F.sum(basis[i] * basis[j]).alias(f"m{i}{j}") for i in range(5) for j in range(i, 5)] + [F.sum(basis[i] * F.col("_y")).alias(f"v{i}") for i in range(5)]
    g = own.groupBy(*keys).agg(*sums, F.min_by("_y", "s").alias("y0"), F.max_by("_y", "s").alias("y1"), F.count("s").alias("n"))
    names = [f"{c}{k}" for k in "12" for c in _HALF]

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if not r["n"]:
                    rows.append([None] * 8)
                    continue
                m = np.array([[r[f"m{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
                v = np.array([r[f"v{i}"] for i in range(5)])
                if endpoints:
                    c = np.array([[1.0, 0, 0, 0, 0], [1, 1, 1, 1, 0.125]])
                    m, v = np.block([[m, c.T], [c, np.zeros((2, 2))]]), np.concatenate([v, [r["y0"], r["y1"]]])
                d, c1, b, a, e = np.linalg.lstsq(m, v, rcond=None)[0][:5]
                rows.append([a, b, c1, d, a + e, b - 1.5 * e, c1 + 0.75 * e, d - 0.125 * e])
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=float)], axis=1)

    kinds = dict(g.dtypes)
    return g.mapInPandas(solve, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} double" for n in names]))


def bspline_basis(knots: np.ndarray, degree: int, s: np.ndarray) -> np.ndarray:
    n = len(knots) - degree - 1
    k = np.clip(np.searchsorted(knots, s, "right") - 1, degree, n - 1)
    out = np.zeros((len(s), n + degree))
    out[np.arange(len(s)), k] = 1
    for p in range(1, degree + 1):
        new = np.zeros_like(out)
        for i in range(n + degree - p):
            for j, w in ((i, lambda: (s - knots[i]) / (knots[i + p] - knots[i])), (i + 1, lambda: (knots[i + p + 1] - s) / (knots[i + p + 1] - knots[i + 1]))):
                if knots[j + p] > knots[j]:
                    new[:, i] += w() * out[:, j]
        out = new
    return out[:, :n]


def fit_splines(df: DataFrame, keys: list[str], t: str = "t", y: str = "y", degree: int = 3, n_knots: int = 3) -> DataFrame:
    """knots, coefficients, degree for each group, of a least-squares B-spline with n_knots equally spaced inner knots;
    coefficients are padded with zeros to the number of knots, and null where a group has one instant. Each batch of rows gives
    its part of the normal equations, Spark adds them up, and only the small systems are solved for a group."""
    knots = np.concatenate([np.zeros(degree + 1), np.arange(1, n_knots + 1) / (n_knots + 1), np.ones(degree + 1)])
    m = len(knots) - degree - 1
    own = normalised(df, keys, t).select(*keys, "s", F.col(y).cast("double").alias("_y"))
    kinds = dict(own.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def sums(batches):
        for pdf in batches:
            ok = pdf["s"].notna() & pdf["_y"].notna()
            some = pdf[ok]
            basis = bspline_basis(knots, degree, some["s"].to_numpy(float))
            rows = np.concatenate([(basis[:, :, None] * basis[:, None, :]).reshape(len(some), -1), basis * some["_y"].to_numpy(float)[:, None]], 1)
            every = np.zeros((len(pdf), rows.shape[1]))
            every[ok.to_numpy()] = rows
            code, first = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy(), ~pdf.duplicated(keys).to_numpy()
            total = np.zeros((int(first.sum()), rows.shape[1]))
            np.add.at(total, code, every)
            yield pdf.loc[first, keys].reset_index(drop=True).assign(z=list(total), n=np.bincount(code, ok, len(total)).astype(int))

    part = own.mapInPandas(sums, f"{head}, z array<double>, n long")
    g = part.groupBy(*keys).agg(F.array(*(F.sum(F.col("z")[i]) for i in range(m * m + m))).alias("z"), F.sum("n").alias("n"))

    def solve(batches):
        for pdf in batches:
            c = [[*np.linalg.lstsq(z[: m * m].reshape(m, m), z[m * m :], rcond=None)[0].tolist(), *[0.0] * (degree + 1)] if n else None for z, n in zip(map(np.asarray, pdf["z"]), pdf["n"])]
            yield pdf[keys].assign(knots=[knots.tolist() if n else None for n in pdf["n"]], coefficients=c, degree=degree)

    return g.mapInPandas(solve, f"{head}, knots array<double>, coefficients array<double>, degree int")


def fit_multi_splines(df: DataFrame, keys: list[str], t: str = "t", y: str = "y", **how) -> DataFrame:
    """As fit_splines for each component of an array y; every parameter is a list over the components."""
    each = df.select(*keys, F.col(t).alias("t"), F.posexplode(y).alias("dim", "y"))
    one = fit_splines(each, [*keys, "dim"], "t", "y", **how)
    rows = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "knots", "coefficients", "degree"))).alias("v"))
    return rows.select(*keys, *(F.col(f"v.{c}").alias(c) for c in ("knots", "coefficients", "degree")))


register(Model("Constant", lambda p, s: p["xstart"] + 0 * s, lambda p, s: 0.0 * s, fit_constant))
register(Model("Linear", lambda p, s: p["xstart"] + s * (p["xend"] - p["xstart"]), lambda p, s: p["xend"] - p["xstart"] + 0 * s, fit_linear, ("endpoints",)))
register(Model("Sinusoidal", lambda p, s: (p["xstart"] - p["xend"]) / 2 * F.cos(F.pi() * s) + (p["xstart"] + p["xend"]) / 2, lambda p, s: -F.pi() * (p["xstart"] - p["xend"]) / 2 * F.sin(F.pi() * s), fit_sinusoidal))
register(Model("Spline3Knots", lambda p, s: F.when(s < 0.5, _cubic(p, "1", s)).otherwise(_cubic(p, "2", s)), lambda p, s: F.when(s < 0.5, _cubic_slope(p, "1", s)).otherwise(_cubic_slope(p, "2", s)), fit_spline3knots, ("endpoints",)))
register(Model("Splines", lambda p, s: _spline_value(p["knots"], p["coefficients"], p["degree"], s), lambda p, s: _spline_slope(p["knots"], p["coefficients"], p["degree"], s), fit_splines, ("degree", "n_knots"), True))
register(Model("MultiBSplines", fit=fit_multi_splines, options=("degree", "n_knots")))
register(Model("Messages"))


def multi_value(p: Column, s: Column, slope: bool = False, pieces: Column | None = None) -> Column:
    """An array with the value, or the slope, of each component of a MultiBSplines activity; by pieces (see with_multi_pieces)
    where they are at hand."""
    if pieces is not None:
        return F.transform(pieces, lambda x: piece_value(x, s, slope))
    of = _spline_slope if slope else _spline_value
    return F.transform(F.arrays_zip(p["knots"].alias("knots"), p["coefficients"].alias("coefficients"), p["degree"].alias("degree")), lambda d: of(d["knots"], d["coefficients"], d["degree"], s))


def fit(modelname: str, df: DataFrame, keys: list[str], t: str = "t", y: str = "y", **options) -> DataFrame:
    """The parameters of a model by name for each group; unknown models and options raise ValueError."""
    m = MODELS.get(modelname)
    if m is None or m.fit is None:
        raise ValueError(f"no model to fit named {modelname}")
    if wrong := set(options) - set(m.options):
        raise ValueError(f"{modelname} has no option {sorted(wrong)}")
    return m.fit(df, keys, t, y, **options)


def fit_shared(df: DataFrame, keys: list[str], design: list[Column], y: str = "y") -> DataFrame:
    """Least squares for any model that is linear in shared parameters, given each sample's row of the design: sums are
    native, only the small systems are solved in Python. Returns the parameters p and the root mean squared error, which
    comes from the residuals."""
    m = len(design)
    own = df.withColumns({f"_d{i}": d for i, d in enumerate(design)}).withColumn("_y", F.col(y))
    d = [F.col(f"_d{i}") for i in range(m)]
    g = own.groupBy(*keys).agg(F.array(*(F.sum(d[i] * d[j]) for i in range(m) for j in range(m))).alias("m"), F.array(*(F.sum(v * F.col("_y")) for v in d)).alias("v"))
    kinds = dict(g.dtypes)

    def solve(batches):
        for pdf in batches:
            yield pdf[keys].assign(p=[np.linalg.lstsq(np.array(a).reshape(m, m), np.array(b), rcond=None)[0].tolist() for a, b in zip(pdf["m"], pdf["v"])])

    p = g.mapInPandas(solve, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["p array<double>"]))
    e = F.col("_y") - sum((F.col("p")[i] * d[i] for i in range(m)), F.lit(0.0))
    return own.join(p, keys).groupBy(*keys).agg(F.first("p").alias("p"), F.sqrt(F.avg(e * e)).alias("rmse"))


def message_parameters(defaults: Column, overrides: Column) -> Column:
    """A message activity's parameters: JSON texts laid over each other, field by field, as a map; a field of the overrides
    wins, a null one too. A network given as an object counts by its uid."""
    kind = "map<string,string>"
    over = F.transform_values(F.from_json(overrides, kind), lambda k, v: F.when(k == "network", F.coalesce(F.get_json_object(v, "$.uid"), v)).otherwise(v))
    base = F.coalesce(F.from_json(defaults, kind), F.create_map().cast(kind))
    over = F.coalesce(over, F.create_map().cast(kind))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def message_struct(parameters: Column) -> Column:
    """The fields that messages have, from a map of parameters."""
    fields = (x.split(":") for x in MESSAGE_PARAMETERS.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(*(parameters[f].cast(kind).alias(f) for f, kind in fields))


def fit_nonlinear(df: DataFrame, keys: list[str], function: Callable[[dict[str, Column], Column], Column], start: dict[str, float | Column], t: str = "t", y: str = "y", rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """keys, the parameters by name, rmse, rounds and converged: least squares for any function of parameters and time, for all
    groups at once, by Gauss and Newton's steps with Levenberg and Marquardt's damping.

    function makes a native column from columns of the parameters and t; start has a value, or a column of df that is the same
    throughout a group, for each. A round evaluates the function and its differences at every sample where it lies and adds up
    J'J and J'r natively; only these small sums, a row a group, are solved in Python and written for the next round. A step
    that lowers the error is taken and the damping divided by ten, else undone and the damping multiplied. A group ends, as
    converged, when a step moves no parameter by more than `tolerance` of its size or lowers the error by no more than that
    share of it or of the values' own; and, marked as not converged, after `rounds` rounds, or when damping passes 1e12. Rows
    with a null t or y don't count; a group without others has null parameters."""
    names, m = list(start), len(start)
    kinds = dict(df.dtypes)
    own = df.withColumns({"_t": F.col(t).cast("double"), "_y": F.col(y).cast("double")}).filter("_t is not null and _y is not null")
    first = df.groupBy(*keys).agg(F.array(*((F.first(v) if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in start.values())).alias("p"))
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    state = f"{head}, p array<double>, tried array<double>, sums array<double>, damping double, n long, steps int, converged boolean"
    now = staged(first.select(*keys, "p", F.col("p").alias("tried"), F.lit(None).cast("array<double>").alias("sums"), F.lit(1e-3).alias("damping"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("steps"), F.lit(None).cast("boolean").alias("converged")))
    samples = staged(own.select(*keys, "_t", "_y"))
    at = lambda p: function(dict(zip(names, p)), F.col("_t"))
    tried = [F.col("tried")[k] for k in range(m)]
    width = [F.greatest(F.abs(v), F.lit(1e-3)) * 1e-6 for v in tried]
    slope = [(at([v + h if i == k else v for i, v in enumerate(tried)]) - at([v - h if i == k else v for i, v in enumerate(tried)])) / (2 * h) for k, h in enumerate(width)]
    j, r = [F.col(f"_j{k}") for k in range(m)], F.col("_r")
    # The error, the values' own size, J'r and the upper half of J'J.
    sums = F.array(F.sum(r * r), F.sum(F.col("_y") * F.col("_y")), *(F.sum(x * r) for x in j), *(F.sum(j[i] * j[k]) for i in range(m) for k in range(i, m)))

    def step(batches):
        upper = np.triu_indices(m)
        for pdf in batches:
            rows = []
            for x in pdf.to_dict("records"):
                p, new, best = np.array(x["p"], float), x["new"], x["sums"]
                done = True if new is None else None
                if new is not None:
                    new = np.array(new, float)
                    better = np.isfinite(new).all() and (best is None or new[0] <= best[0])
                    if better:
                        moved, gained = np.array(x["tried"], float) - p, np.inf if best is None else best[0] - new[0]
                        p, damping = np.array(x["tried"], float), max(x["damping"] / 10, 1e-12)
                        small = best is not None and (np.abs(moved) <= tolerance * np.maximum(np.abs(p), tolerance)).all()
                        done = True if small or gained <= tolerance * min(new[0], 1) or new[0] <= 1e-24 * new[1] else None
                        best = new
                    else:
                        damping = x["damping"] * 10
                        done = False if damping > 1e12 or best is None else None
                    x["damping"] = damping
                tried = p
                if done is None:
                    a = np.zeros((m, m))
                    a[upper] = best[2 + m :]
                    a = a + np.triu(a, 1).T
                    tried = p + np.linalg.lstsq(a + x["damping"] * np.diag(np.maximum(np.diag(a), 1e-12)), best[2 : 2 + m], rcond=None)[0]
                rows.append({**{k: x[k] for k in keys}, "p": p.tolist(), "tried": tried.tolist(), "sums": None if best is None else list(best), "damping": x["damping"], "n": int(x["count"]), "steps": x["steps"] + 1, "converged": done})
            yield pd.DataFrame(rows)[[*keys, "p", "tried", "sums", "damping", "n", "steps", "converged"]]

    ended = []
    for _ in range(rounds):
        here = samples.join(now.select(*keys, "tried"), keys).withColumns({"_r": F.col("_y") - at(tried), **{f"_j{k}": s for k, s in enumerate(slope)}})
        got = here.groupBy(*keys).agg(sums.alias("new"), F.count("*").alias("count"))
        now = staged(now.join(got, keys, "left").fillna(0, ["count"]).mapInPandas(step, state))
        ended.append(now.filter("converged is not null"))
        now = now.filter("converged is null")
        if now.isEmpty():
            break
    out = now
    for e in ended:
        out = out.unionByName(e)
    none = F.col("n") == 0
    return out.select(*keys, *(F.when(~none, F.col("p")[k]).alias(c) for k, c in enumerate(names)), F.when(~none, F.sqrt(F.col("sums")[0] / F.col("n"))).alias("rmse"), F.col("steps").alias("rounds"), F.coalesce(F.col("converged") & ~none, F.lit(False)).alias("converged"))
