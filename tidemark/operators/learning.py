"""Out-of-fold learning on folds: one task fits one fold of one key. Boosted trees of this package, with path-dependent Shapley
values, stand for libraries that are not there."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import average_rank, spread
from tidemark.functions.trees import Boosted, Logistic, stump
from tidemark.sources.scratch import written

CANDIDATES = {"boosted": Boosted, "shallow": lambda: Boosted(trees=60, depth=2), "logistic": Logistic}
#: The grid that a search goes over: trees by number, depth and rate, and lines by ridge.
GRID = {f"trees_{n}_{depth}_{rate}": (lambda n=n, depth=depth, rate=rate: Boosted(trees=n, depth=depth, rate=rate)) for n in (40, 120) for depth in (2, 4) for rate in (0.05, 0.2)}
GRID |= {f"line_{ridge}": (lambda ridge=ridge: Logistic(ridge)) for ridge in (0.01, 1.0, 100.0)}


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else float("nan")


def fold_predictions(rows: DataFrame, folds: DataFrame, features: list[str], key: str, kinds: tuple[str, ...] = ("boosted",), importance: bool = False, only: DataFrame | None = None) -> DataFrame:
    """key, kind, fold_id, row_pos, p, y, shift, shap: the prediction for each row that a fold tests.

    rows: key, row_pos, label (0 or 1) and features (null counts as 0); folds: key, fold_id, row_pos, role. Folds with no training
    rows or one class are skipped. shift: for each feature, how far the prediction moves when the tested rows' values of it
    are dealt anew; shap: the feature's share of the log odds (both empty unless asked for). One task holds the rows of one fold of one key. only: the kinds of each key (key, kind) that are fitted.
    """
    known = CANDIDATES | GRID
    if unknown := set(kinds) - set(known):
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    both = folds.join(rows.na.fill(0.0, features).select(key, "row_pos", F.col("label").cast("double").alias("label"), *features), [key, "row_pos"])
    each = both.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    each = each if only is None else each.join(F.broadcast(only), [key, "kind"], "left_semi")  # a row a candidate

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("row_pos", kind="stable")
        train, test = d[d["role"] == "train"], d[d["role"] == "test"]
        if train["label"].nunique() < 2 or test.empty:
            return pd.DataFrame(columns=[key, "kind", "fold_id", "row_pos", "p", "y", "shift", "shap"])
        x = test[features].to_numpy(dtype=float)
        model = known[d["kind"].iloc[0]]().fit(train[features].to_numpy(dtype=float), train["label"].to_numpy())
        p = model.predict(x)
        shift: list = [[]] * len(test)
        shap = shift
        if importance:
            rng, moved = np.random.default_rng(42), np.empty(x.shape)
            for f in range(x.shape[1]):
                other = x.copy()
                other[:, f] = rng.permutation(other[:, f])
                moved[:, f] = np.abs(model.predict(other) - p)
            shift, shap = list(moved), list(model.attributions(x)[1])
        return pd.DataFrame({key: test[key], "kind": test["kind"], "fold_id": test["fold_id"], "row_pos": test["row_pos"], "p": p, "y": test["label"], "shift": shift, "shap": shap})

    kind = rows.schema[key].dataType.simpleString()
    return spread(each, key, "kind", "fold_id").groupBy(key, "kind", "fold_id").applyInPandas(fit, f"{key} {kind}, kind string, fold_id int, row_pos long, p double, y double, shift array<double>, shap array<double>")


def out_of_fold_by(rows: DataFrame, folds: DataFrame, features: list[str], key: str, kind: str = "boosted") -> DataFrame:
    """key, row_pos, p: the mean prediction over the folds that test a row."""
    return out_of_fold(fold_predictions(rows, folds, features, key, (kind,)), key)


def out_of_fold(got: DataFrame, key: str) -> DataFrame:
    """out_of_fold_by() from fold_predictions() rows of one kind."""
    return got.groupBy(key, "row_pos").agg(F.avg("p").alias("p"))


def importance_by(rows: DataFrame, folds: DataFrame, features: list[str], key: str, kind: str = "boosted") -> DataFrame:
    """key, feature, shap, shift, place: mean size of a feature's share of the log odds of the out-of-fold predictions, pooled over
    folds, largest first, and mean move of the prediction when its values are dealt anew."""
    return importance(fold_predictions(rows, folds, features, key, (kind,), True), features, key)


def importance(got: DataFrame, features: list[str], key: str) -> DataFrame:
    """importance_by() from fold_predictions() rows of one kind that have shap and shift."""
    from pyspark.sql import Window as W

    long = got.select(key, F.posexplode(F.arrays_zip("shap", "shift")).alias("i", "v"))
    names = F.array(*map(F.lit, features))
    out = long.groupBy(key, "i").agg(F.avg(F.abs("v.shap")).alias("shap"), F.avg("v.shift").alias("shift")).select(key, F.element_at(names, F.col("i") + 1).alias("feature"), "shap", "shift")
    return out.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("shap"), "feature")))


def board_of(got: DataFrame, key: str) -> DataFrame:
    """key, kind, auc, log_loss, brier, n, place of fold_predictions() rows: best first by the area under the curve over all tested
    rows (null, and last, where they have one class), then by log loss."""
    from pyspark.sql import Window as W

    q = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))
    ones = F.sum("y")
    area = (F.sum(F.when(F.col("y") == 1, F.col("rank"))) - ones * (ones + 1) / 2) / F.nullif(ones * (F.count("*") - ones), F.lit(0.0))
    ranks = got.withColumn("rank", average_rank(F.col("p"), key, "kind"))
    out = ranks.groupBy(key, "kind").agg(area.alias("auc"), F.avg(loss).alias("log_loss"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.count("*").alias("n"))
    return out.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last("auc"), "log_loss", "kind")))


def leaderboard_by(rows: DataFrame, folds: DataFrame, features: list[str], key: str) -> DataFrame:
    """board_of() the candidates of each key."""
    return board_of(fold_predictions(rows, folds, features, key, tuple(CANDIDATES)), key)


def fold_losses(got: DataFrame, *key: str) -> DataFrame:
    """key, folds, median_loss, mean_loss, most_loss: the log loss of each fold of fold_predictions() rows, over the folds."""
    q = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    each = got.groupBy(*key, "fold_id").agg(F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("loss"))
    return each.groupBy(*key).agg(F.count("*").alias("folds"), F.median("loss").alias("median_loss"), F.avg("loss").alias("mean_loss"), F.max("loss").alias("most_loss"))


def search_by(rows: DataFrame, folds: DataFrame, features: list[str], key: str, budget: int = 40, kinds: tuple[str, ...] = tuple(GRID)) -> DataFrame:
    """board_of() the grid's candidates by successive halving, with `rung`, the last round that a candidate took part in, and `fits`, the
    fits of a key so far. In each round the candidates that are left are fitted on the next fold and judged on all folds so far; the
    better half goes on, until one is left, or the next round would go beyond a budget of fits a key; what is left
    then has the later rung. The best comes first: by rung, then by area."""
    from pyspark.sql import Window as W

    numbers = sorted(r[0] for r in folds.select("fold_id").distinct().collect())
    seen, alive, left, fits, boards = None, None, len(kinds), 0, None
    for rung, fold in enumerate(numbers):
        if left < 1 or fits + left > budget:
            break
        got = written(fold_predictions(rows, folds.where(F.col("fold_id") == fold), features, key, kinds, only=alive))
        seen = got if seen is None else seen.join(F.broadcast(alive), [key, "kind"], "left_semi").unionByName(got)
        fits += left
        board = written(board_of(seen, key).withColumns({"rung": F.lit(rung), "fits": F.lit(fits)}))
        boards = board if boards is None else boards.unionByName(board)
        if left == 1:
            break
        left = -(-left // 2)
        alive = board.where(F.col("place") <= left).select(key, "kind")
    last = boards.withColumn("latest", F.max("rung").over(W.partitionBy(key, "kind"))).where("rung = latest").drop("latest", "place")
    return last.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("rung"), F.desc_nulls_last("auc"), "log_loss", "kind")))


def leader_metadata(board: DataFrame, key: str, train_n: DataFrame, used_folds: bool) -> DataFrame:
    """key and a JSON text of the leader: its name, metric, the board, training rows, and whether a fold column was used."""
    entry = F.struct("place", "kind", "auc", "log_loss", "brier", "n")
    out = board.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("board")).join(train_n.select(key, "train_n"), key)  # a row a candidate
    first = F.element_at("board", 1)
    record = F.struct(first["kind"].alias("leader_id"), first["auc"].alias("leader_metric"), F.lit("auc").alias("metric_name"), F.col("board").alias("leaderboard"), "train_n", F.lit(used_folds).alias("used_fold_column"))
    return out.select(key, F.to_json(record).alias("metadata"))


def stumps(df: DataFrame, key: str, variables: list[str], label: str = "up") -> DataFrame:
    """key, variable, cut, accuracy, up_under, up_over, trivial, n: the best single split of each variable.

    df: key, label (0 or 1) and variables; rows with a null among them are left out. One task holds one variable of one key.
    """
    fine = df.select(key, F.col(label).cast("double").alias("y"), *variables).dropna()
    long = fine.select(key, "y", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("e")).select(key, "y", "e.*")

    def best(d: pd.DataFrame) -> pd.DataFrame:
        y = d["y"].to_numpy()
        cut, accuracy, under, over = (None if np.isnan(v) else v for v in stump(d["x"].to_numpy(), y))
        return pd.DataFrame({key: [d[key].iloc[0]], "variable": [d["variable"].iloc[0]], "cut": [cut], "accuracy": [accuracy], "up_under": [under], "up_over": [over], "trivial": [max(y.mean(), 1 - y.mean())], "n": [len(y)]}).astype({c: "Float64" for c in ("cut", "up_under", "up_over")})

    kind = df.schema[key].dataType.simpleString()
    return spread(long, key, "variable").groupBy(key, "variable").applyInPandas(best, f"{key} {kind}, variable string, cut double, accuracy double, up_under double, up_over double, trivial double, n long")


def read_metadata(text: str) -> dict:
    return json.loads(text)
