"""A fitted run as a folder of tables, and a scorer that needs nothing but that folder.

``layout`` lists what each position of the raw vector holds (columns, category levels, flags), ``features`` and ``weights``
the affine map from raw vectors to features with the coefficients, ``isotonic`` the steps of the monotone maps (months,
and the probability at each horizon), ``numbers`` the conformal quantiles, thresholds and the version, ``trees`` and
``quantiles`` the boosted quantiles of a run with those. Numbers are stored as doubles, so scores survive unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators import boosting, features
from hazardframe.operators.boosting import TREE_SCHEMA, QuantileModel
from hazardframe.plans.modelling import ModelRun
from hazardframe.sources.readers import path_exists

VERSION = 1
SCHEMAS = {
    "layout": "position int, kind string, block string, name string, level string, flag boolean",
    "features": "position int, name string, block string, shift double, coefficient double",
    "weights": "feature int, raw int, weight double",
    "isotonic": "name string, step int, boundary double, value double",
    "numbers": "name string, value double",
    "trees": "bound string, " + TREE_SCHEMA,
    "quantiles": "bound string, quantile double, start double, rate double",
}


@dataclass
class Steps:
    """A monotone map: linear between the steps, constant beyond the ends."""

    boundaries: np.ndarray
    values: np.ndarray

    def apply(self, score: Column) -> Column:
        boundaries, values = self.boundaries, self.values

        @F.pandas_udf("double")
        def lookup(x: pd.Series) -> pd.Series:
            raw = x.to_numpy(dtype=float)
            return pd.Series(np.where(np.isnan(raw), np.nan, np.interp(raw, boundaries, values)))

        return lookup(score)


@dataclass
class Bundle:
    """What scoring needs. ``numbers``: ``qhat`` of the month interval, ``qhat-h`` and ``threshold-h`` of horizon h."""

    layout: features.Layout
    space: features.FeatureSpace
    coefficients: np.ndarray
    steps: dict[str, Steps] = field(default_factory=dict)
    numbers: dict[str, float] = field(default_factory=dict)
    quantiles: dict[str, QuantileModel] = field(default_factory=dict)

    @staticmethod
    def of(run: ModelRun) -> Bundle:
        steps, numbers, quantiles = {}, {}, {}
        month = run.interval
        if month.status == "ok":
            numbers["qhat"] = float(month.qhat)
            if isinstance(month.models[0], QuantileModel):
                quantiles = dict(zip(("low", "high"), month.models))
            else:
                steps["months"] = _steps(month.models[0])
        for h, found in run.calibrators.items():
            steps[f"horizon-{h}"] = _steps(found["isotonic"])
            numbers |= {f"qhat-{h}": float(found["qhat"]), f"threshold-{h}": float(found["threshold"])}
        return Bundle(run.layout, run.space, np.asarray(run.fit.coef, float), steps, numbers, quantiles)

    def save(self, spark: SparkSession, path: str) -> None:
        rows: dict[str, list[tuple]] = {name: [] for name in SCHEMAS}
        cells = [("numeric", b, c, None, c in self.layout.flags) for b, c in self.layout.numeric]
        cells += [("categorical", "clinical", c, v, False) for c, values in self.layout.categorical for v in (values or [None])]
        cells += [("omics", b, c, None, False) for b, names in self.layout.omics.items() for c in names]
        rows["layout"] = [(i, *cell) for i, cell in enumerate(cells)]
        rows["features"] = [
            (i, n, b, float(o), float(c)) for i, (n, b, o, c) in enumerate(zip(self.space.names, self.space.blocks, self.space.offset, self.coefficients))
        ]
        rows["weights"] = [(int(f), int(r), float(self.space.weights[r, f])) for r, f in zip(*np.nonzero(self.space.weights))]
        rows["isotonic"] = [(n, i, float(x), float(y)) for n, s in self.steps.items() for i, (x, y) in enumerate(zip(s.boundaries, s.values))]
        rows["numbers"] = [("version", float(VERSION)), ("width", float(self.layout.width)), *self.numbers.items()]
        rows["trees"] = [(bound, *row) for bound, m in self.quantiles.items() for row in m.tree_rows()]
        rows["quantiles"] = [(bound, m.quantile, m.start, m.rate) for bound, m in self.quantiles.items()]
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(rows[name], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        if not path_exists(spark, f"{path}/numbers"):
            raise FileNotFoundError(f"no model at {path}")
        # Tables of a model: a row for each column, feature, weight, step or tree node.
        t = {name: spark.read.parquet(f"{path}/{name}").toPandas() for name in SCHEMAS}
        numbers = dict(zip(t["numbers"]["name"], t["numbers"]["value"]))
        if numbers.pop("version", None) != VERSION:
            raise ValueError(f"{path} is not a model of version {VERSION}")
        cells = t["layout"].sort_values("position")
        categorical: dict[str, list[str]] = {}
        omics: dict[str, list[str]] = {}
        for r in cells.itertuples():
            if r.kind == "categorical":
                categorical.setdefault(r.name, [])
                if r.level is not None:
                    categorical[r.name].append(r.level)
            elif r.kind == "omics":
                omics.setdefault(r.block, []).append(r.name)
        numeric = [(r.block, r.name) for r in cells.itertuples() if r.kind == "numeric"]
        flags = frozenset(cells.loc[cells["flag"], "name"])
        layout = features.Layout(numeric, list(categorical.items()), omics, flags=flags)
        if layout.width != int(numbers.pop("width")):
            raise ValueError(f"the layout in {path} does not fit its weights")
        listed = t["features"].sort_values("position")
        weights = np.zeros((layout.width, len(listed)))
        weights[t["weights"]["raw"], t["weights"]["feature"]] = t["weights"]["weight"]
        space = features.FeatureSpace(weights, listed["shift"].to_numpy(), listed["name"].tolist(), listed["block"].tolist(), {})
        steps = {n: Steps(g["boundary"].to_numpy(), g["value"].to_numpy()) for n, g in t["isotonic"].sort_values("step").groupby("name")}
        quantiles = {
            r.bound: QuantileModel.from_rows(r.quantile, r.start, r.rate, t["trees"][t["trees"]["bound"] == r.bound]) for r in t["quantiles"].itertuples()
        }
        return Bundle(layout, space, listed["coefficient"].to_numpy(), steps, numbers, quantiles)

    def score(self, df: DataFrame, swap_crossed: bool = True) -> DataFrame:
        """``df`` with risk_score, the month interval where the run has one, and for each calibrated horizon h p_event_h, its
        bounds and the class at the threshold. A missing column the model knows is an error; new category levels count as none."""
        known = [c for _, c in self.layout.numeric] + [c for c, _ in self.layout.categorical] + [c for names in self.layout.omics.values() for c in names]
        lacking = [c for c in known if c not in df.columns]
        if lacking:
            raise ValueError(f"columns missing: {', '.join(lacking)}")
        out = features.with_features(df, self.layout, {features.ALL: self.space}, name="_x")
        out = out.withColumn("risk_score", S.dot("_x", self.coefficients.tolist()))
        if self.quantiles:
            for bound, model in self.quantiles.items():
                out = model.transform(out, f"_{bound}", "_x")
            out = out.withColumns(boosting.interval_columns(("_l", "_h"), "_low", "_high", swap_crossed))
            low = F.greatest(F.col("_l") - self.numbers["qhat"], F.lit(0.0))
            out = out.withColumns({"pred_survival_lo_months_90": low, "pred_survival_hi_months_90": F.greatest(low, F.col("_h") + self.numbers["qhat"])})
            out = out.drop("_low", "_high", "_l", "_h")
        elif "months" in self.steps:
            out = out.withColumn("_m", self.steps["months"].apply(F.col("risk_score")))
            bounds = {"pred_survival_lo_months_90": -self.numbers["qhat"], "pred_survival_hi_months_90": self.numbers["qhat"]}
            out = out.withColumns({n: F.greatest(F.expm1(F.col("_m") + q), F.lit(0.0)) for n, q in bounds.items()}).drop("_m")
        for name, steps in self.steps.items():
            if name.startswith("horizon-"):
                h = name.removeprefix("horizon-")
                out = out.withColumn(f"p_event_{h}", steps.apply(F.col("risk_score")))
                p, q = F.col(f"p_event_{h}"), self.numbers[f"qhat-{h}"]
                out = out.withColumns({
                    f"p_event_lo_{h}": F.greatest(p - q, F.lit(0.0)), f"p_event_hi_{h}": F.least(p + q, F.lit(1.0)),
                    f"event_{h}": (p >= self.numbers[f"threshold-{h}"]).cast("int"),
                })
        return out.drop("_x")


def _steps(model) -> Steps:
    return Steps(np.array(model.boundaries.toArray(), float), np.array(model.predictions.toArray(), float))
