"""Long predictions to the tables a forecast report is made of."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.evaluate import (
    common_support, ensemble_against_best, horizon_winners, scores, win_counts, winners,
)
from weekloom.operators.folds import block_scores, fold_scores, rolling_folds, stability
from weekloom.operators.forecast import route, usage_share
from weekloom.operators.panel import combine_sources

MODEL_ORDER = ("persistence", "forest", "boosted", "sequence")


@dataclass(frozen=True)
class Report:
    """Lazy result tables; each is computed when it is read or written."""

    by_horizon: DataFrame
    by_entity: DataFrame
    winners: DataFrame
    win_counts: DataFrame
    horizon_winners: DataFrame
    ensemble: DataFrame
    usage: DataFrame


def ensemble_report(predictions: Sequence[DataFrame], routing: DataFrame, split: str = "validation",
                    model_order: Sequence[str] = MODEL_ORDER, same_rows: bool = True,
                    keys: Keys = DEFAULT_KEYS) -> Report:
    """Score single models and the routed ensemble. Write ``predictions`` first if they are costly."""
    single = combine_sources(predictions)
    if same_rows:
        single = common_support(single, keys)
    routed = route(single, routing, keys)
    everything = single.unionByName(routed.drop("model_used"))
    by_horizon = scores(everything, ["model", "split", "horizon"], describe=True)
    by_entity = scores(single, ["model", "split", "horizon", keys.entity], describe=True)
    one_split = by_entity.where(F.col("split") == split)
    best = winners(one_split, model_order, by=[keys.entity, "horizon"])
    return Report(
        by_horizon=by_horizon, by_entity=by_entity, winners=best, win_counts=win_counts(best),
        horizon_winners=horizon_winners(one_split, model_order),
        ensemble=ensemble_against_best(by_horizon), usage=usage_share(routed))


def walk_forward_report(predictions: DataFrame, panel: DataFrame, blocks: DataFrame,
                        first: int = 26, step: int = 4, length: int = 4,
                        keys: Keys = DEFAULT_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold scores, their stability, and scores per named period."""
    folds = rolling_folds(panel, first, step, length, keys)
    by_fold = fold_scores(predictions, panel, folds, keys=keys)
    return by_fold, stability(by_fold), block_scores(predictions, panel, blocks, keys=keys)
