"""Feature groups composed into one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tidemark.operators.asof import merge_groups
from tidemark.operators.fundamental import daily_fundamentals, fundamental_ratios
from tidemark.operators.normalize import PanelNormalizer
from tidemark.operators.sentiment import sentiment_features
from tidemark.operators.technical import technical_features


def feature_panel(
    prices: DataFrame, config: Mapping | None = None, fundamentals: DataFrame | None = None,
    sentiment: DataFrame | None = None, graph_features: DataFrame | None = None,
    sectors: DataFrame | None = None,
) -> DataFrame:
    """Merge the enabled groups on (ticker, date). A group without input is left out."""
    config = config or {}

    def on(group: str, default: bool) -> bool:
        return bool((config.get(group) or {}).get("enabled", default))

    groups = []
    if on("technical", True):
        groups.append(technical_features(prices, config=config.get("technical")))
    if on("fundamental", True) and fundamentals is not None:
        chosen = config.get("fundamental") or {}
        skip = {s: v.get("skip", []) for s, v in (chosen.get("sector_specific") or {}).items()}
        groups.append(fundamental_ratios(daily_fundamentals(fundamentals, prices), sectors, skip))
    if on("sentiment", False) and sentiment is not None:
        chosen = config.get("sentiment") or {}
        groups.append(sentiment_features(sentiment, prices, missing_fill=chosen.get("missing_fill", 0.0)))
    if on("graph_derived", False) and graph_features is not None:
        groups.append(graph_features)
    if not groups:
        raise ValueError("no feature group is enabled")
    return merge_groups(groups)


def normalised_panel(panel: DataFrame, train_end: str, normalizer: PanelNormalizer | None = None) -> DataFrame:
    normalizer = normalizer or PanelNormalizer()
    if not normalizer.columns:
        normalizer.fit(panel, train_end)
    return normalizer.transform(panel)
