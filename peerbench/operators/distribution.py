"""The tables behind distribution plots: histograms, densities, samples and point sets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from peerbench.functions import log10
from peerbench.operators.profile import top_values, value_counts_by_column
from peerbench.operators.quantiles import exact_quantiles
from peerbench.operators.tables import positive


def _values(df: DataFrame, col: str, log: bool) -> DataFrame:
    """The non-missing values as ``_v``; on the logarithmic scale only positive ones."""
    value = log10(F.col(col)) if log else F.col(col).cast("double")
    return df.select(value.alias("_v")).where(F.col("_v").isNotNull())


def automatic_bins(n: int, low: float, high: float, iqr: float, whole: bool) -> int:
    """Number of equal bins by the usual automatic rule.

    The narrower of the Sturges width and the Freedman-Diaconis width, the latter not below half
    the square-root width; whole numbers never get bins narrower than 1.
    """
    spread = high - low
    if n == 0 or spread == 0:
        return 1
    sturges = spread / (math.log2(n) + 1)
    relaxed = max(2 * iqr / n ** (1 / 3), spread / math.sqrt(n) / 2)
    width = min(sturges, relaxed)
    return math.ceil(spread / (max(width, 1.0) if whole else width))


def histogram(
    df: DataFrame, col: str, bins: int | None = None, *, log: bool = False
) -> DataFrame:
    """(bin, left, right, n) for every bin, empty ones too; the last bin includes its right border."""
    values = _values(df, col, log)
    whole = isinstance(df.schema[col].dataType, IntegralType) and not log
    facts = values.agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    if facts["n"] == 0:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, n bigint")
    low, high = facts["low"], facts["high"]
    if bins is None:
        q1, q3 = exact_quantiles(values, [], "_v", [0.25, 0.75]).first()["quantiles"]
        bins = automatic_bins(facts["n"], low, high, q3 - q1, whole)
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins

    def border(i: Column) -> Column:
        return F.when(i == bins, F.lit(high)).otherwise(i * F.lit(step) + F.lit(low))

    # The division can land one bin off at a border, so the borders themselves decide.
    rough = F.least(F.floor((F.col("_v") - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    i, v = F.col("_i"), F.col("_v")
    settled = F.when(v < border(i), i - 1).when((v >= border(i + 1)) & (i < bins - 1), i + 1).otherwise(i)
    counts = values.withColumn("_i", rough).groupBy(settled.alias("bin")).agg(F.count("*").alias("n"))
    index = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return index.join(counts, "bin", "left").select(
        "bin", border(F.col("bin")).alias("left"), border(F.col("bin") + 1).alias("right"), F.coalesce("n", F.lit(0)).alias("n")
    )


#: Width of the cells of :func:`density` in bandwidths, and moments of a cell.
CELL = 0.5
MOMENTS = 15


def hermite_table(n: int) -> list[list[float]]:
    """Coefficients by rising power of the first ``n`` Hermite polynomials: H(k + 1) = 2 x H(k) - 2 k H(k - 1)."""
    rows = [[1.0], [0.0, 2.0]]
    for k in range(1, n - 1):
        rows.append([2 * a - 2 * k * b for a, b in zip([0.0, *rows[k]], [*rows[k - 1], 0.0, 0.0])])
    return rows[:n]


def density(df: DataFrame, col: str, grid: int = 200, *, log: bool = False) -> DataFrame:
    """Gaussian density with Scott's bandwidth h at equally spaced points: (point, x, density).

    A fast Gauss transform: values fall into cells ``CELL`` bandwidths wide, and each task adds up the moments
    u^k / k! of a cell, u being the distance to its middle over h sqrt(2). A cell's part at a point is the sum of
    its moments times Hermite functions of the distance of the two, so work per row does not depend on
    ``grid``, and cells, not rows, meet points: those within 10 h. What is left out is below
    1.09 (CELL / 2)^MOMENTS / sqrt(MOMENTS!) / (1 - CELL / 2) / (h sqrt(2 pi)) + e^-50 / (h sqrt(2 pi)),
    that is 5e-16 / h.
    """
    values = _values(df, col, log)
    facts = values.agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.stddev_samp("_v").alias("sd")).first()
    n, low, high, sd = facts["n"], facts["low"], facts["high"], facts["sd"]
    if n < 2 or not sd:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    h = sd * n ** (-1 / 5)
    width, step, scale = CELL * h, (high - low) / (grid - 1), h * math.sqrt(2)
    at = lambda i: i * F.lit(step) + F.lit(low)
    middle = lambda cell: (cell + 0.5) * F.lit(width) + F.lit(low)

    placed = values.withColumn("_cell", F.floor((F.col("_v") - low) / width)).select("_cell", ((F.col("_v") - middle(F.col("_cell"))) / scale).alias("_u"))
    power, moments = F.lit(1.0), []
    for k in range(MOMENTS):
        moments.append(F.sum(power / float(math.factorial(k))).alias(f"_m{k}"))
        power = power * F.col("_u")
    cells = placed.groupBy("_cell").agg(*moments)
    # A cell's polynomial in the distance to a point, by rising power.
    table = hermite_table(MOMENTS)
    by_power = [sum((F.col(f"_m{k}") * table[k][j] for k in range(j, MOMENTS) if table[k][j]), F.lit(0.0)).alias(f"_b{j}") for j in range(MOMENTS)]
    reach = lambda side: F.ceil((middle(F.col("_cell")) - low - side * 10 * h) / step)
    near = F.sequence(F.greatest(reach(1), F.lit(0)).cast("int"), F.least(reach(-1), F.lit(grid - 1)).cast("int"))
    there = F.greatest(reach(1), F.lit(0)) <= F.least(reach(-1), F.lit(grid - 1))
    met = cells.where(there).select("_cell", *by_power, F.explode(near).alias("point"))
    t = (at(F.col("point")) - middle(F.col("_cell"))) / scale
    met = met.withColumn("_t", t)
    curve = F.lit(0.0)
    for j in reversed(range(MOMENTS)):
        curve = curve * F.col("_t") + F.col(f"_b{j}")
    heights = met.groupBy("point").agg((F.sum(F.exp(-F.col("_t") * F.col("_t")) * curve) / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))
    points = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("point"))
    return points.join(heights, "point", "left").select("point", at(F.col("point")).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def restrict_to_top(df: DataFrame, col: str, k: int) -> DataFrame:
    """The rows whose category is among the ``k`` most frequent; the list of k is broadcast."""
    top = top_values(df, col, k).select(col)
    return df.join(F.broadcast(top), col, "left_semi").select(*df.columns)


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``n`` rows without replacement, or the whole table if it has no more.

    Every row's place in a shuffled order is a hash of its key and the seed, so the sample is the
    same on every run and layout. Only rows under a cut on the hash are ordered: the cut expects
    slightly more than ``n`` rows, is checked by a count, and is raised if too few fall under it.
    """
    total = df.count()
    if total <= n:
        return df
    place = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    shuffled = df.withColumn("_place", place)
    share = (n + 10 * math.sqrt(n) + 10) / total
    while share < 0.5:
        under = shuffled.where(F.col("_place") < f"{int(share * 16**8):08x}")
        if under.count() >= n:
            shuffled = under
            break
        share *= 2
    return shuffled.orderBy("_place", key).limit(n).drop("_place")


def scatter_points(df: DataFrame, x: str, y: str, cap: int | None, seed: int, key: str) -> DataFrame:
    """Points of two columns that are positive in ``y``: of all rows, or of ``cap`` sampled ones."""
    return positive(df if cap is None else sample_rows(df, cap, seed, key), y).select(key, x, y)


def scatter_cells(df: DataFrame, x: str, y: str, cells: int = 50, *, log: bool = True) -> DataFrame:
    """What a scatter of all rows positive in ``y`` shows: (cell_x, cell_y, n, mean_x, mean_y) of each cell of a
    grid of ``cells`` by ``cells`` that holds points; y is cut on the logarithmic scale unless ``log`` is off.

    Counts and sums (exact if the columns are) come from one aggregate within tasks first, so at most ``cells``
    squared rows a task are shuffled."""
    rows = positive(df, y).where(F.col(x).isNotNull()).select(F.col(x).alias("_a"), F.col(y).alias("_b"), F.col(x).cast("double").alias("_x"))
    rows = rows.withColumn("_h", log10(F.col("_b")) if log else F.col("_b").cast("double"))
    facts = rows.agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("_x", "_h") for f in (F.min, F.max)]).first()
    if facts["min_x"] is None:
        return df.sparkSession.createDataFrame([], "cell_x int, cell_y int, n bigint, mean_x double, mean_y double")

    def cell(c: str) -> Column:
        low, high = facts[f"min{c}"], facts[f"max{c}"]
        if low == high:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - low) * cells / (high - low)), F.lit(cells - 1)).cast("int")

    return rows.groupBy(cell("_x").alias("cell_x"), cell("_h").alias("cell_y")).agg(F.count("*").alias("n"), *[(F.sum(c).cast("double") / F.count("*")).alias(name) for c, name in (("_a", "mean_x"), ("_b", "mean_y"))])


def bar_counts(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each column, stacked: (column, place, value, n)."""
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    counts = value_counts_by_column(df, cols)
    return counts.withColumn("place", place).where(F.col("place") <= k).select("column", "place", "value", "n")
