"""A memo of requests in a stream: a repeat within its time gets the stored answer, and the oldest entries make room."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Entries and seconds of the published memo.
ENTRIES, SECONDS = 2048, 600

_OUT = "key string, ts timestamp, place long, answer double, hit boolean"


def remembered(stream: DataFrame, key: str, time: str, place: str, answer: Callable[[str | None], float], entries: int = ENTRIES, seconds: float = SECONDS, shards: int = 1) -> DataFrame:
    """(key, ts, place, answer, hit): each request with its answer, computed at most once while it is remembered.

    Requests that come together are taken by ``time``, then ``place`` (a long). An entry serves requests up to ``seconds`` after
    the one that it was computed for, by their times; once there are ``entries`` of them a new one pushes out the oldest. Keys
    are dealt to ``shards`` by hash, each with a memo of its own share of the entries, so that a stream of any width
    can be served; with one shard the memo is the published one. The state of a shard is its entries, no more. Null keys
    are answered like any.
    """
    most = max(1, entries // shards)
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(place).cast("long").alias("place"))

    def serve(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Entries as [key, answer, seconds], the oldest first: a dictionary keeps the order in which they came.
        known = {k: (a, t) for k, a, t in json.loads(state.get[0])} if state.exists else {}
        together = pd.concat(list(batches)).sort_values(["ts", "place"], kind="stable")
        answers, hits = [], []
        for request, at in zip(together["key"], together["ts"]):
            request, now = None if pd.isna(request) else request, at.timestamp()
            stored = known.get(request)
            hit = stored is not None and now - stored[1] <= seconds
            if not hit:
                known.pop(request, None)
                while len(known) >= most:
                    known.pop(next(iter(known)))
                stored = known[request] = (answer(request), now)
            answers.append(stored[0])
            hits.append(hit)
        state.update((json.dumps([[k, a, t] for k, (a, t) in known.items()]),))
        yield together[["key", "ts", "place"]].assign(answer=answers, hit=hits)

    return rows.groupBy("shard").applyInPandasWithState(serve, _OUT, "entries string", "append", GroupStateTimeout.NoTimeout)
