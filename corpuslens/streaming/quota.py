"""Per-class quota on a stream (K1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_per_class(stream: DataFrame, label: str, n: int) -> DataFrame:
    """Accept the first ``n`` rows of every label and drop the rest.

    Each task forwards at most ``n`` rows per label and batch, so a label with most of the
    stream sends a bounded number of rows to the task that keeps its count.
    """
    schema = stream.schema

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for batch in batches:
            place = batch.groupby(label, dropna=False).cumcount()
            room = batch[label].map(lambda v: n - seen.get(v, 0))
            kept = batch[place < room]
            for value, count in kept[label].value_counts(dropna=False).items():
                seen[value] = seen.get(value, 0) + int(count)
            yield kept

    def accept(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else 0
        for batch in batches:
            kept = batch.iloc[: max(0, n - taken)]
            taken += len(kept)
            if len(kept):
                yield kept
        state.update((taken,))

    return stream.mapInPandas(head, schema).groupBy(label).applyInPandasWithState(
        accept, schema, T.StructType([T.StructField("taken", T.LongType())]), "append",
        GroupStateTimeout.NoTimeout)
