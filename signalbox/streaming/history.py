"""Recent history per conversation, kept as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "conv_id long, position int, role string, content string"
STATE = "turns array<long>, roles array<string>, texts array<string>"


def history_stream(messages: DataFrame, last: int = 10, idle_timeout_ms: int | None = None) -> DataFrame:
    """Messages for the next call after each micro-batch: recent pairs, then the newest user message.

    The state holds the messages by ``turn`` from the (last + 1)th newest user message on, so the
    result does not depend on the order in which they arrive, and a message that comes again counts
    once. The state of a conversation that went quiet is dropped after the timeout, if one is given.
    A query with a timeout never ends by itself, so an available-now trigger needs None.
    """
    timeout = (
        GroupStateTimeout.ProcessingTimeTimeout if idle_timeout_ms else GroupStateTimeout.NoTimeout
    )

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen = {turn: (role, text) for turn, role, text in zip(*state.get)} if state.exists else {}
        for batch in batches:
            spoken = batch[batch["role"].isin(["user", "assistant"])]
            seen.update((int(turn), (role, text)) for turn, role, text in zip(spoken["turn"], spoken["role"], spoken["text"]))
        opened = sorted(turn for turn, (role, _) in seen.items() if role == "user")[-(last + 1) :]
        # Before any user message is known, an earlier one may still come and claim the replies.
        turns = sorted(turn for turn in seen if len(opened) <= last or turn >= opened[0])
        state.update((turns, [seen[t][0] for t in turns], [seen[t][1] for t in turns]))
        if idle_timeout_ms:
            state.setTimeoutDuration(idle_timeout_ms)
        pairs: list[list] = []
        for turn in turns:
            role, text = seen[turn]
            if role == "user":
                pairs.append([text, ""])
            elif pairs:
                pairs[-1][1] = text
        out = [(role, text) for pair in pairs[:-1] for role, text in zip(("user", "assistant"), pair)]
        out += [("user", pair[0]) for pair in pairs[-1:]]
        yield pd.DataFrame(
            [(key[0], i + 1, role, text) for i, (role, text) in enumerate(out)],
            columns=["conv_id", "position", "role", "content"],
        )

    return messages.groupBy("conv_id").applyInPandasWithState(update, OUTPUT, STATE, "update", timeout)
