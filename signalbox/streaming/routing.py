"""Online routing: the batch selector applied to a stream, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from signalbox.operators.history import non_empty_messages
from signalbox.operators.routing import SELECTOR_THRESHOLD, select_model


def route_stream(
    messages: DataFrame, threshold: float = SELECTOR_THRESHOLD, score: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Select a model for every non-empty message of a stream.

    ``score`` adds the two scores to a stream that does not carry them, such as ``TextHeads.score``.
    """
    wanted = non_empty_messages(messages)
    return select_model(score(wanted) if score else wanted, threshold)
