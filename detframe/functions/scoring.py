"""Running a user's own model over image rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from detframe.sources.schemas import RAW_PREDICTIONS


def batch_score(images: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Raw predictions of a user model.

    ``load_model`` runs once per task and returns a function from a batch of
    image rows to rows of ``image_id, layer, pos, v``.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(score, RAW_PREDICTIONS)
