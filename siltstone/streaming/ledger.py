"""The ledger of sessions as stream state: what a session has seen so far, kept by key and given anew with every trigger that adds to it.

State is the first place of each file, chunk, query and decision of the session, and counters; a key's rows of a trigger come in Arrow batches. A
session that is silent for longer than its time to live is forgotten. Served tokens are counted up to a threshold; a
trigger that crosses it asks for a summary and starts counting again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LISTS = ("files", "chunks", "queries", "decisions")
OUT = "session string, " + ", ".join(f"n_{name} long, {name} array<string>" for name in LISTS) + ", searches long, tokens_saved long, served_tokens long, summarise boolean"
STATE = "seen string, searches long, saved long, served long, unsummed long"


def _step(most: int, threshold: int | None, ttl_ms: int | None, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held, searches, saved, served, unsummed = state.get if state.exists else ("{}", 0, 0, 0, 0)
    seen = {name: {} for name in LISTS} | json.loads(held)
    for frame in frames:
        for event in frame.itertuples(index=False):
            found = [("files", event.file_path), ("chunks", event.chunk_id)]
            if event.kind == "search":
                found.append(("queries", event.query))
                searches, saved = searches + 1, saved + int(event.tokens_saved)
                served, unsummed = served + int(event.served_tokens), unsummed + int(event.served_tokens)
            elif event.kind == "decision":
                found.append(("decisions", event.id))
            for name, item in found:
                if isinstance(item, str):
                    seen[name][item] = min(int(event.ord), seen[name].get(item, 1 << 62))
    summarise = threshold is not None and unsummed >= threshold
    state.update((json.dumps(seen), searches, saved, served, 0 if summarise else unsummed))
    if ttl_ms:
        state.setTimeoutDuration(ttl_ms)
    row = {"session": key[0]}
    for name, items in seen.items():
        listed = sorted(items) if name in ("files", "chunks") else sorted(items, key=lambda x: (items[x], x))  # noqa: B023
        row |= {f"n_{name}": len(items), name: listed[:most]}
    yield pd.DataFrame([row | {"searches": searches, "tokens_saved": saved, "served_tokens": served, "summarise": summarise}])


def ledger(events: DataFrame, most: int = 20, threshold: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """events: session, ord, kind, query, file_path, chunk_id, id, tokens_saved, served_tokens. A row a session and trigger that adds to it: its lists
    (see metrics.session_digest), counters, and whether it is time for a summary. Run the stream in update mode."""
    rows = events.selectExpr("cast(session as string) as session", "ord", "kind", "query", "file_path", "chunk_id", "id", "coalesce(tokens_saved, 0L) as tokens_saved", "coalesce(served_tokens, 0L) as served_tokens")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("session").applyInPandasWithState(partial(_step, most, threshold, ttl_ms), OUT, STATE, "Update", timeout)
