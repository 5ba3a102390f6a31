"""A preprocessor that is fitted once and applied to many tables, and a composer that plans one from what columns are."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import moments, order_stats
from . import encode, impute, profile, scale, transforms

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


@dataclass
class Moments:
    """Count, mean, sum of squared deviations and extremes, which merge without cancellation."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float = math.inf
    high: float = -math.inf

    def merged(self, o: Moments) -> Moments:
        n = self.n + o.n
        if n == 0:
            return Moments()
        gap = o.mean - self.mean
        return Moments(n, self.mean + gap * o.n / n, self.m2 + o.m2 + gap * gap * self.n * o.n / n, min(self.low, o.low), max(self.high, o.high))

    @property
    def std(self) -> float:
        return math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else 0.0


@dataclass
class Preprocessor:
    """Imputes, scales and encodes: numeric columns by ``fill`` and ``scaler``, others by ``category_fill`` and ``encoder``.

    ``fit`` learns parameters, a few aggregates; ``transform`` is a projection (target and label encoders join a small
    table). Columns that weren't fitted pass through. Fills are mean, median, mode, constant (0, or "missing") or none;
    scalers those of ``scale`` (or none), encoders one_hot, label, frequency or none. Label numbers values in their order.
    """

    fill: str = "mean"
    scaler: str = "standard"
    category_fill: str = "mode"
    encoder: str = "one_hot"
    most_categories: int = 1000
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    scales: dict[str, scale.Params] = field(default_factory=dict)
    tables: dict[str, list] = field(default_factory=dict)
    running: dict[str, Moments] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> Preprocessor:
        kinds = dict(df.dtypes)
        columns = list(df.columns) if columns is None else columns
        self.numeric = [c for c in columns if is_numeric(kinds[c])]
        self.categorical = [c for c in columns if kinds[c] in ("string", "boolean")]
        df = df.withColumns({c: F.col(c).cast("double") for c in self.numeric} | {c: F.col(c).cast("string") for c in self.categorical})
        if self.fill == "median":
            self.fills = {c: x[0] for c, x in order_stats.summaries(df, self.numeric, ()).items()}
        elif self.fill == "mean" and self.numeric:
            self.fills = df.agg(*[F.avg(c).alias(c) for c in self.numeric]).first().asDict()
        else:
            self.fills = {c: impute.mode(df, c) if self.fill == "mode" else 0.0 if self.fill == "constant" else None for c in self.numeric}
        self.fills |= {c: impute.mode(df, c) if self.category_fill == "mode" else "missing" if self.category_fill == "constant" else None for c in self.categorical}
        filled = self._filled(df)
        self.scales = {} if self.scaler == "none" or not self.numeric else scale.fit(filled, self.numeric, self.scaler)
        self.tables = {}
        if self.encoder != "none":
            rows = df.count() if self.encoder == "frequency" else 0
            for c in self.categorical:
                if self.encoder == "frequency":
                    counts = filled.where(F.col(c).isNotNull()).groupBy(c).count().limit(self.most_categories + 1).collect()
                    if len(counts) > self.most_categories:
                        raise ValueError(f"{c} has more than {self.most_categories} values; raise most_categories or use encode.frequency")
                    self.tables[c] = sorted((r[0], r[1] / rows) for r in counts)
                else:
                    self.tables[c] = encode.categories(filled, c, self.most_categories)
        self.running = {}
        return self.partial_fit(df)

    def partial_fit(self, df: DataFrame) -> Preprocessor:
        """Adds the moments of another batch to the running statistics of the numeric columns; fills and scales stay."""
        if not self.numeric:
            return self
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{i}") for c in self.numeric for i, f in enumerate((F.count, F.avg, F.var_pop, F.min, F.max))]).first()
        for c in self.numeric:
            n, mean, var, low, high = (row[f"{c}__{i}"] for i in range(5))
            self.running[c] = self.running.get(c, Moments()).merged(Moments(n, mean or 0.0, (var or 0.0) * n, math.inf if low is None else low, -math.inf if high is None else high))
        return self

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fills.items() if v is not None})

    def transform(self, df: DataFrame) -> DataFrame:
        if not (self.numeric or self.categorical):
            raise ValueError("the preprocessor isn't fitted")
        out = df.withColumns({c: F.col(c).cast("double") for c in self.numeric} | {c: F.col(c).cast("string") for c in self.categorical})
        out = scale.transform(self._filled(out), self.scales)
        for c, values in self.tables.items():
            if self.encoder == "one_hot":
                out = encode.one_hot(out, c, values)
            else:
                known = dict(values) if self.encoder == "frequency" else {v: i for i, v in enumerate(values)}
                code = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col(c)] if known else F.lit(None)
                out = out.withColumn(c, F.coalesce(code, F.lit(0.0)) if self.encoder == "frequency" else code)
        return out

    def inverse(self, df: DataFrame) -> DataFrame:
        """Scaled numeric columns as they were before scaling; filled values stay filled."""
        return scale.inverse(df, self.scales)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Preprocessor:
        x = json.loads(text)
        x["scales"] = {c: scale.Params(**p) for c, p in x["scales"].items()}
        x["running"] = {c: Moments(**m) for c, m in x["running"].items()}
        x["tables"] = {c: [tuple(v) if isinstance(v, list) else v for v in t] for c, t in x["tables"].items()}
        return cls(**x)

    def save(self, df_or_spark, path: str) -> None:
        """Writes the fitted parameters as one text file, through Spark's file systems."""
        spark = getattr(df_or_spark, "sparkSession", df_or_spark)
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> Preprocessor:
        return cls.from_json(spark.read.text(path).first()[0])


def optimized(df: DataFrame, columns: list[str]) -> Preprocessor:
    """A preprocessor (not fitted) whose scaler and fill suit sparsity, outliers, skewness and missing values of the columns."""
    row = profile.characteristics(df, columns).first()
    return Preprocessor(scaler=row["scaler"], fill="median" if row["skewness"] > 1 else "mean")


@dataclass(frozen=True)
class Step:
    """One step of a plan: drop, impute, encode, outliers, transform, scale or select, its method and its columns."""

    action: str
    method: str
    columns: tuple[str, ...]


def detected(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column what a plan depends on: rows, missing, n_unique, numeric, drop (constant or like an id) and skew."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if is_numeric(kinds[c])]
    skews = df.agg(*[moments.skew_sample(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    counts = profile.per_column(df, columns, {"rows": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(F.col(c).isNull()), "n_unique": F.count_distinct}).collect()
    out = {}
    for r in counts:
        ratio = r["n_unique"] / r["rows"] if r["rows"] else 0.0
        categorical = r["column"] not in numeric or (r["n_unique"] <= 50 and ratio < 0.05)
        out[r["column"]] = {"rows": r["rows"], "missing": r["missing"], "n_unique": r["n_unique"], "numeric": not categorical, "drop": r["n_unique"] <= 1 or (ratio > 0.95 and r["n_unique"] > 100 and kinds[r["column"]] not in ("float", "double")), "skew": skews.get(r["column"])}
    return out


def compose(schema: dict[str, dict], regression: bool = False, most_missing: float = 0.5, most_skew: float = 2.0, most_features: int = 20) -> list[Step]:
    """The steps for columns as ``detected``: drop what is constant, like an id or mostly missing; impute by median or mode;
    encode up to 10 values as one-hot and more by target (regression) or frequency; clip; transform skewed columns; scale;
    and select by mutual information where there are more than ``most_features`` columns."""
    kept = {c: x for c, x in schema.items() if not x["drop"]}
    numeric, other = [c for c, x in kept.items() if x["numeric"]], [c for c, x in kept.items() if not x["numeric"]]
    empty = [c for c, x in kept.items() if x["missing"] and x["missing"] / x["rows"] > most_missing]
    some = [c for c, x in kept.items() if x["missing"] and c not in empty]
    gone = set(empty)
    plan = [
        ("drop", "unusable", [c for c, x in schema.items() if x["drop"]]), ("drop", "missing", empty),
        ("impute", "median", [c for c in some if c in numeric]), ("impute", "mode", [c for c in some if c in other]),
        ("encode", "one_hot", [c for c in other if kept[c]["n_unique"] <= 10 and c not in gone]), ("encode", "target" if regression else "frequency", [c for c in other if kept[c]["n_unique"] > 10 and c not in gone]),
        ("outliers", "clip", [c for c in numeric if c not in gone]), ("transform", "yeo_johnson", [c for c in numeric if abs(kept[c]["skew"] or 0.0) > most_skew and c not in gone]),
        ("scale", "standard", [c for c in numeric if c not in gone]), ("select", "mutual_information", list(kept) if len(schema) > most_features else []),
    ]
    return [Step(action, method, tuple(columns)) for action, method, columns in plan if columns]


def models(schema: dict[str, dict], task: str = "binary") -> list[str]:
    """Models worth trying: boosting and forests, a linear one below 100 columns, and neighbours below 10 000 rows."""
    rows, columns = next((x["rows"] for x in schema.values()), 0), sum(not x["drop"] for x in schema.values())
    out = ["boosted", "forest"]
    if task == "regression" or (task == "binary" and columns < 100):
        out.append("linear")
    return [*out, "knn"] if task == "binary" and rows < 10_000 else out


def complexity(schema: dict[str, dict], steps: list[Step]) -> float:
    """Between 0 and 1, from rows, columns, steps, missing values and categorical columns."""
    n = max(1, len(schema))
    rows = next((x["rows"] for x in schema.values()), 0)
    missing = sum(x["missing"] / x["rows"] for x in schema.values() if x["rows"]) / n
    other = sum(not x["numeric"] and not x["drop"] for x in schema.values())
    return min(1.0, 0.1 * math.log10(max(1, rows)) + 0.2 * math.log10(n) + 0.1 * len(steps) + 0.3 * missing + 0.2 * other / n)


def applied(df: DataFrame, steps: list[Step], y: str | None = None, most_features: int = 20, lam: float = 0.5) -> DataFrame:
    """``df`` after the steps, in order: clipping is at 3 deviations, Yeo-Johnson has a fixed lambda, and encoding and
    selection are really done; target encoding and selection need ``y``."""
    out = df
    for step in steps:
        columns = [c for c in step.columns if c in out.columns]
        if step.action == "drop":
            out = out.drop(*columns)
        elif step.action == "impute":
            middle = order_stats.summaries(out, columns, ()) if step.method == "median" else {c: (impute.mode(out, c),) for c in columns}
            out = out.withColumns({c: F.coalesce(F.col(c), F.lit(x[0])) for c, x in middle.items() if x[0] is not None})
        elif step.action == "encode":
            for c in columns:
                if step.method == "one_hot":
                    out = encode.one_hot(out, c)
                elif step.method == "target" and y:
                    table, overall = encode.target(out, c, y)
                    out = encode.lookup(out, c, table, "mean", overall)
                else:
                    out = encode.frequency(out, c)
        elif step.action == "outliers":
            out = out.withColumns({c: F.col(c).cast("double") for c in columns})
            row = out.agg(*[f(c).alias(f"{c}__{i}") for c in columns for i, f in enumerate((F.avg, F.stddev_pop))]).first()
            for c in columns:
                out = transforms.treat(out, c, (row[f"{c}__0"] - 3 * row[f"{c}__1"], row[f"{c}__0"] + 3 * row[f"{c}__1"]), "clip")
        elif step.action == "transform":
            out = out.withColumns({c: transforms.yeo_johnson(F.col(c), lam) for c in columns})
        elif step.action == "scale":
            out = scale.transform(out, scale.fit(out, columns, step.method))
        elif step.action == "select" and y:
            from .features import mutual_information

            candidates = [c for c, k in out.dtypes if c != y and is_numeric(k)]
            best = mutual_information(out, candidates, y).orderBy(F.desc("mi"), "column").limit(most_features).collect()
            out = out.select(*[c for c in out.columns if c in {r["column"] for r in best} or c not in candidates])
    return out
