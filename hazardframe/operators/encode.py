"""Cohort preparation: join, encode, impute, scale."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.functions.scalar import MIN_TRAIN_ROWS, clean, mapped
from hazardframe.operators.ordered import quantiles, range_bounds, running
from hazardframe.session import settle
from hazardframe.sources.tables import numeric_features, quoted

CHUNK = 200  # columns per aggregate, to keep generated code small

# Ordinal stage and binary gender codes and their defaults.
STAGE_CODES = {"I": 1, "II": 2, "IIIa": 3, "IIIb": 4}
STAGE_DEFAULT = 3
GENDER_CODES = {"male": 1, "female": 0}
GENDER_DEFAULT = 1


def merge_cohort(features: DataFrame, clinical: DataFrame, id_col: str) -> DataFrame:
    """Inner join on the subject id; repeated ids multiply, shared other columns get ``_x`` and ``_y``."""
    shared = (set(features.columns) & set(clinical.columns)) - {id_col}
    tag = lambda d, s: d.select(*[F.col(quoted(c)).alias(c + s if c in shared else c) for c in d.columns])
    return tag(features, "_x").join(tag(clinical, "_y"), id_col)


def cohort_counts(df: DataFrame, id_col: str) -> DataFrame:
    """Rows, distinct subjects and whether subjects repeat, in one aggregate over per-subject counts."""
    return (df.groupBy(id_col).agg(F.count("*").alias("__n"))
            .agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count(id_col).alias("n_subjects"))
            .withColumn("has_duplicates", F.col("n_subjects") < F.col("n_rows")))


def map_encode(df: DataFrame, column: str, codes: dict, default) -> DataFrame:
    """Replace a category by its code; unmapped and null become ``default``. A missing column is left alone."""
    if column not in df.columns:
        return df
    return df.withColumn(column, mapped(F.col(quoted(column)), codes, default))


@dataclass
class OneHot:
    """Indicator columns in byte order of the categories, the first dropped; null counts as ``Unknown``."""

    column: str
    drop_first: bool = True
    unknown: str = "Unknown"
    levels: list[str] | None = None

    def _filled(self) -> Column:
        return F.coalesce(F.col(quoted(self.column)), F.lit(self.unknown))

    def fit(self, df: DataFrame, max_levels: int = 10_000) -> "OneHot":
        if self.column in df.columns:
            seen = df.select(self._filled().alias("v")).distinct().orderBy("v").limit(max_levels + 1).collect()
            if len(seen) > max_levels:
                raise ValueError(f"{self.column} has more than {max_levels} categories.")
            self.levels = [r.v for r in seen]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns:
            return df
        kept = self.levels[1:] if self.drop_first else self.levels
        others = [F.col(quoted(c)) for c in df.columns if c != self.column]
        return df.select(*others, *[(self._filled() == v).cast("int").alias(f"{self.column}_{v}") for v in kept])


@dataclass
class CohortEncoder:
    """The three encoders of a cohort, learned once so that later data gets the same columns."""

    stage: str
    gender: str
    histology: str
    stage_codes: dict = field(default_factory=lambda: dict(STAGE_CODES))
    gender_codes: dict = field(default_factory=lambda: dict(GENDER_CODES))
    one_hot: OneHot | None = None

    def fit(self, df: DataFrame) -> "CohortEncoder":
        self.one_hot = OneHot(self.histology).fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        df = map_encode(df, self.stage, self.stage_codes, STAGE_DEFAULT)
        df = map_encode(df, self.gender, self.gender_codes, GENDER_DEFAULT)
        return self.one_hot.transform(df)


def survival_target(df: DataFrame, time: str, event: str) -> DataFrame:
    """Add ``time`` as double and ``event`` as boolean."""
    return df.withColumns({"time": F.col(quoted(time)).cast("double"), "event": F.col(quoted(event)).cast("boolean")})


def assemble(df: DataFrame, names: list[str], keep: list[str], out: str = "features") -> DataFrame:
    """Pack numeric columns into one ``array<double>`` column; nulls stay null inside the array."""
    cells = [clean(F.col(quoted(n)).cast("double")) for n in names]
    return df.select(*[F.col(quoted(k)) for k in keep], F.array(*cells).alias(out))


def require_min_rows(df: DataFrame, least: int = MIN_TRAIN_ROWS) -> None:
    """Stop before a fit on too few rows; reads no more rows than needed."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"training needs {least} rows or more and this table is too small: {n}")


def size_status(df: DataFrame, by: list[str], least: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Rows of each group and whether they are enough for a fit: the guard as a table, for many cohorts at once."""
    n = F.col("n_rows")
    return df.groupBy(*by).agg(F.count("*").alias("n_rows")).withColumn("status", F.when(n >= least, "ok").otherwise(F.concat(F.lit("too small: "), n.cast("string"))))


def _cells(column: str, p: int, masks: list[Column | None]) -> list[Column]:
    """The cells of the feature array, once per row mask: position ``g * p + j`` is feature j under mask g."""
    plain = [clean(F.col(column)[j]) for j in range(p)]
    return [v if m is None else F.when(m, v) for m in masks for v in plain]


def _chunked_row(df: DataFrame, cells: list[Column], functions: list) -> list:
    """Aggregate every cell with every function, ``CHUNK`` cells per scan; returns one tuple per cell."""
    out = []
    for at in range(0, len(cells), CHUNK):
        row = df.agg(*[f(c) for c in cells[at:at + CHUNK] for f in functions]).first()
        out += [tuple(row[i:i + len(functions)]) for i in range(0, len(row), len(functions))]
    return out


def masked_medians(df: DataFrame, column: str, names: list[str], masks: list[Column | None] = (None,)) -> list[list[float]]:
    """Exact medians of every array position under every row mask.

    One scan brackets each median between two values of a sketch; a second counts what lies below and keeps only
    the values inside the brackets, about 0.2 % of the cells, so the wide matrix itself is never shuffled.
    """
    p = len(names)
    cells = _cells(column, p, list(masks))
    sketch = lambda c: F.percentile_approx(c, [0.499, 0.501], 10_000)
    brackets = [(n, lo, hi) if n < 5_000 else (n, q[0], q[1])
                for n, q, lo, hi in _chunked_row(df, cells, [F.count, sketch, F.min, F.max])]
    empty = sorted({names[i % p] for i, b in enumerate(brackets) if b[0] == 0})
    if empty:
        raise ValueError(f"Columns without any value cannot be imputed: {empty}")
    low, high = F.lit([float(b[1]) for b in brackets]), F.lit([float(b[2]) for b in brackets])
    zipped = F.arrays_zip(F.array(*cells).alias("v"), low.alias("lo"), high.alias("hi"))
    flat = df.select(F.posexplode(zipped).alias("pos", "c")).select("pos", "c.*").where("v IS NOT NULL AND v <= hi")
    # Everything below a bracket collapses to one entry per position before the shuffle.
    kept = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    counts, n_counts = settle(flat.groupBy("pos", kept.alias("v")).agg(F.count("*").alias("n")))
    below = {r.pos: r.n for r in counts.where("v IS NULL").collect()}
    counts = counts.where("v IS NOT NULL")
    ranked = running(counts, ["pos"], "v", {"hi": ("sum", "n")}, bounds=range_bounds(counts, "v", n_counts))

    def value_at(rank) -> Column:
        wanted = F.lit([rank(b[0]) - below.get(i, 0) for i, b in enumerate(brackets)])[F.col("pos")]
        return F.max(F.when((wanted < F.col("hi")) & (wanted >= F.col("hi") - F.col("n")), F.col("v")))

    rows = ranked.groupBy("pos").agg(value_at(lambda n: (n - 1) // 2).alias("a"),
                                     value_at(lambda n: n // 2).alias("b")).collect()
    found = {r.pos: (r.a + r.b) / 2 for r in rows}
    return [[found[g * p + j] for j in range(p)] for g in range(len(masks))]


def masked_moments(df: DataFrame, column: str, names: list[str], masks: list[Column | None] = (None,),
                   fills: list[list[float]] | None = None) -> tuple[list[list[float]], list[list[float]]]:
    """Population mean and deviation of every position under every mask, nulls replaced by ``fills``.

    A constant column gets deviation one.
    """
    p = len(names)
    cells = []
    for g, m in enumerate(masks):
        for j in range(p):
            v = clean(F.col(column)[j])
            v = v if fills is None else F.coalesce(v, F.lit(float(fills[g][j])))
            cells.append(v if m is None else F.when(m, v))
    rows = _chunked_row(df, cells, [F.avg, F.stddev_pop])
    grid = lambda k, f: [[f(rows[g * p + j][k]) for j in range(p)] for g in range(len(masks))]
    return grid(0, float), grid(1, lambda s: float(s) if s else 1.0)


@dataclass
class MedianImputer:
    """Exact per-position medians of an ``array<double>`` column, learned on the training rows."""

    names: list[str]
    column: str = "features"
    medians: list[float] | None = None

    def fit(self, df: DataFrame) -> "MedianImputer":
        self.medians = masked_medians(df, self.column, self.names)[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.zip_with(F.col(self.column), F.lit([float(m) for m in self.medians]),
                                                     lambda v, m: F.coalesce(clean(v), m)))


@dataclass
class ZScore:
    """Population mean and deviation per position, learned on the training rows."""

    names: list[str]
    column: str = "features"
    means: list[float] | None = None
    deviations: list[float] | None = None

    def fit(self, df: DataFrame) -> "ZScore":
        means, deviations = masked_moments(df, self.column, self.names)
        self.means, self.deviations = means[0], deviations[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = F.zip_with(F.zip_with(F.col(self.column), F.lit(self.means), lambda v, m: v - m),
                            F.lit(self.deviations), lambda v, s: v / s)
        return df.withColumn(self.column, scaled)


def column_medians(df: DataFrame, names: list[str]) -> DataFrame:
    """Exact medians of plain columns, one row per column name."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(quoted(n)).cast("double").alias("v"))
                                         for n in names])).alias("c")).select("c.*")
    return quantiles(long, "v", {"median": 0.5}, ["feature"])


__all__ = ["merge_cohort", "cohort_counts", "map_encode", "OneHot", "CohortEncoder", "survival_target", "assemble",
           "require_min_rows", "masked_medians", "masked_moments", "MedianImputer", "ZScore", "column_medians", "numeric_features"]
