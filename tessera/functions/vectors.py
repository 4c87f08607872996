"""Vectors as array<double> columns: metrics, transforms and mergeable statistics.

Everything is a Column expression, so it stays in the JVM and next to the scan.
A metric of vectors that have no direction (zero or constant) is null, never NaN,
and so loses every arg-min.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def finite(v: Column | str) -> Column:
    """Whether a vector is there, and all its components are: none null, NaN or infinite."""
    return F.coalesce(F.forall(_col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _over(x: Column, y: Column) -> Column:
    """x / y, null where y is zero."""
    return F.when(y != 0, x / y)


def squared_euclid(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def euclid(a, b) -> Column:
    return F.sqrt(squared_euclid(a, b))


def cosine(a, b) -> Column:
    a, b = _col(a), _col(b)
    return 1 - _over(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centred(v) -> Column:
    """The vector less its own mean."""
    v = _col(v)
    return F.get(F.transform(F.array(total(v) / F.size(v)), lambda m: F.transform(v, lambda x: x - m)), F.lit(0))


def pearson(a, b) -> Column:
    return cosine(centred(a), centred(b))


def dc_penalty(a, b, bands: int, by: float = 0.2) -> Column:
    """``by`` for each band whose first value differs by more than ``by``."""
    a, b = _col(a), _col(b)
    first = lambda v, i: F.get(v, (i * F.size(v) / bands).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bands - 1)), F.lit(0.0), lambda s, i: s + F.when(F.abs(first(a, i) - first(b, i)) > by, by).otherwise(0.0))


def pspearson(a, b, bands: int = 4) -> Column:
    return pearson(a, b) + dc_penalty(a, b, bands)


def gradients(v) -> Column:
    v = _col(v)
    return F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda y, x: y - x)


def gradpearson(a, b, by: float = 0.2) -> Column:
    """Pearson plus ``by`` for each inner index where gradients have opposite signs and differ by more than ``by``."""
    inner = lambda v: F.slice(gradients(v), 1, F.size(_col(v)) - 2)
    return pearson(a, b) + total(F.zip_with(inner(a), inner(b), lambda x, y: F.when((x * y < 0) & (F.abs(x - y) > by), by).otherwise(0.0)))


def fractional_euclid(a, b) -> Column:
    """Squared differences over squared means; places where both are zero add nothing."""
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.coalesce(_over((x - y) * (x - y), 0.25 * (x + y) * (x + y)), F.lit(0.0))))


def rectangle_distance(v, low, high) -> Column:
    """Squared Euclidean distance of a point from an upright box; zero inside."""
    under = F.zip_with(_col(v), _col(low), lambda x, b: F.greatest(b - x, F.lit(0.0)))
    over = F.zip_with(_col(v), _col(high), lambda x, b: F.greatest(x - b, F.lit(0.0)))
    away = F.zip_with(under, over, lambda x, y: x + y)
    return dot(away, away)


def centre_distance(x0, y0, x1, y1) -> Column:
    """Distance of two integer points, truncated."""
    return F.hypot(_col(x0) - _col(x1), _col(y0) - _col(y1)).cast("int")


Metric = Callable[[Column, Column], Column]
METRICS: dict[str, Metric] = {
    "squared_euclid": squared_euclid, "euclidean": euclid, "cosine": cosine, "pearson": pearson,
    "pspearson": pspearson, "gradpearson": gradpearson, "fraceuclidean": fractional_euclid,
}


def metric(name: str, **options) -> Metric:
    """A metric by name; ``register`` adds further ones."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {sorted(METRICS)}")
    return partial(METRICS[name], **options) if options else METRICS[name]


def register(name: str, build: Metric) -> None:
    METRICS[name] = build


# --- transforms -----------------------------------------------------------------


def log_floor_train(v, floor: float = 1e-6) -> Column:
    """Natural logarithm; zero counts as ``floor``."""
    return F.transform(_col(v), lambda x: F.ln(F.when(x == 0, floor).otherwise(x)))


def log_floor_infer(v, floor) -> Column:
    """Natural logarithm; values up to zero count as ``floor``, which is ``least_nonzero`` of the data."""
    floor = _col(floor) if not isinstance(floor, float) else F.lit(floor)
    return F.transform(_col(v), lambda x: F.ln(F.when(x <= 0, floor).otherwise(x)))


def least_nonzero(df: DataFrame, v: str, share: float = 0.9) -> DataFrame:
    """One row: ``share`` of the smallest value that is not zero."""
    return df.select(F.array_min(F.filter(v, lambda x: x != 0)).alias("m")).agg((F.min("m") * share).alias("floor"))


def zscore(v, mean, std) -> Column:
    """A deviation of zero counts as one."""
    return F.zip_with(F.zip_with(_col(v), _col(mean), lambda x, m: x - m), _col(std), lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))


def mean_centre(v, mean) -> Column:
    return F.zip_with(_col(v), _col(mean), lambda x, m: x - m)


def row_l1(v) -> Column:
    """The row over its sum; a sum of zero leaves it as it is."""
    v = _col(v)
    return F.when(total(v) == 0, v).otherwise(F.transform(v, lambda x: x / total(v)))


def row_l2(v) -> Column:
    v = _col(v)
    return F.when(dot(v, v) == 0, v).otherwise(F.transform(v, lambda x: x / F.sqrt(dot(v, v))))


def midpoint(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: (x + y) / 2)


def move_toward(a, b, rate: float) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + (y - x) * rate)


def decayed(error, last, now, rate: float = 0.995) -> Column:
    """An error as it stands now, when it was last touched at ``last``."""
    return _col(error) * F.pow(F.lit(rate), _col(now) - _col(last) - 1)


def checked_length(v, length: int) -> Column:
    """The vector; another length is an error at run time."""
    v = _col(v)
    return F.when(F.size(v) == length, v).otherwise(F.raise_error(F.format_string("vector of length %d, not " + str(length), F.size(v))).cast("array<double>"))


# --- statistics ---------------------------------------------------------------------


def vector_stats(df: DataFrame, v: str, dim: int, by: list[str] | None = None) -> DataFrame:
    """(by..., n, mean array, std array): sample deviation, zero counted as one; one aggregate, no explosion of rows."""
    at = lambda f: F.array(*(f(F.get(v, F.lit(i))) for i in range(dim)))
    std = lambda x: F.when(F.coalesce(F.stddev_samp(x), F.lit(0.0)) == 0, 1.0).otherwise(F.stddev_samp(x))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), at(F.avg).alias("mean"), at(std).alias("std"))


def partial_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, mean, m2): a mergeable state; m2 is the sum of squared deviations."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_stats(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Merges states: (by..., n, mean, std).

    Deviations of the states' means from the overall mean are added to those
    within, so large means cancel nothing.  Null keys are keys.
    """
    by = by or []
    states = states.select(*by, "n", "mean", "m2")
    overall = states.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m")).select(*(F.col(c).alias(f"_{c}") for c in by), "_m")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)) if by else None
    met = states.join(overall, same) if by else states.crossJoin(F.broadcast(overall))  # without keys it is one row
    away = F.col("mean") - F.col("_m")
    sums = met.groupBy(*by).agg(F.sum("n").alias("n"), F.first("_m").alias("_m"), F.sum(F.col("n") * away).alias("s"), F.sum(F.col("m2") + F.col("n") * away * away).alias("q"))
    # what rounding left of the mean is taken away again
    left = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return sums.select(*by, "n", (F.col("_m") + F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(left, F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0))).alias("std"))


# --- random numbers -------------------------------------------------------------------


def draw(kind: str, seed: int, **p) -> Column:
    """Random numbers of a distribution, made of uniform and normal ones with seeds of their own.

    Kinds and options: uniform (low, high), normal (mean, std), exponential and laplace and cauchy and
    lognormal (mean, scale), weibull (shape, scale), chi2 and student (degrees), gamma and inverse_gamma
    (shape, a multiple of a half, and scale), beta (a, b, multiples of a half).
    """
    mean, scale = p.get("mean", 0.0), p.get("scale", 1.0)
    unit = 1 - F.rand(seed)  # never zero
    centred_unit = F.rand(seed) - 0.5

    def chi2(degrees: float, salt: int) -> Column:
        if degrees != int(degrees) or degrees < 1:
            raise ValueError("a whole number of degrees of freedom is asked for")
        return reduce(lambda a, b: a + b, (F.pow(F.randn(seed + salt + 7919 * i), 2) for i in range(int(degrees))))

    def gamma(shape: float, salt: int) -> Column:
        return chi2(2 * shape, salt) / 2

    kinds: dict[str, Callable[[], Column]] = {
        "uniform": lambda: p.get("low", 0.0) + (p.get("high", 1.0) - p.get("low", 0.0)) * F.rand(seed),
        "normal": lambda: mean + p.get("std", 1.0) * F.randn(seed),
        "exponential": lambda: -F.ln(unit) * p.get("mean", 1.0),
        "laplace": lambda: mean - scale * F.signum(centred_unit) * F.ln(F.greatest(1 - 2 * F.abs(centred_unit), F.lit(1e-300))),
        "cauchy": lambda: mean + scale * F.tan(centred_unit * 3.141592653589793),
        "lognormal": lambda: F.exp(mean + scale * F.randn(seed)),
        "weibull": lambda: scale * F.pow(-F.ln(unit), 1 / p["shape"]),
        "chi2": lambda: chi2(p["degrees"], 1),
        "student": lambda: F.randn(seed) / F.sqrt(chi2(p["degrees"], 1) / p["degrees"]),
        "gamma": lambda: gamma(p["shape"], 1) * scale,
        "inverse_gamma": lambda: 1 / (gamma(p["shape"], 1) * (1 / scale)),
        "beta": lambda: (lambda x, y: x / (x + y))(gamma(p["a"], 1), gamma(p["b"], 104729)),
    }
    if kind not in kinds:
        raise ValueError(f"unknown distribution {kind!r}; there are {sorted(kinds)}")
    return kinds[kind]()
