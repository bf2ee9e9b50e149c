"""Hard-negative miner: the loss table of a model, built and stored once, then ranked by any criterion."""

from __future__ import annotations

from pyspark.sql import DataFrame

from detframe.operators.loss import total_loss
from detframe.operators.mining import hard_negatives
from detframe.session import materialize


class HardNegativeMiner:
    """``components`` is a table of per-image losses, as ``image_loss_components`` gives it."""

    def __init__(self, components: DataFrame):
        self.table = materialize(total_loss(components), "losses")

    def hardest(self, n: int, criterion: str = "total_loss") -> DataFrame:
        """The n images with the largest value of a column of the table; ties by image."""
        return hard_negatives(self.table, n, criterion)
