"""The release feed as a keyed stateful stream: what was announced, and which names stand for which album.

The decision about a release depends on what was booked earlier in the same poll, so it is a fold over each
source's polls with durable state, by ``applyInPandasWithState``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feltloom.plans.flows import decide_releases
from feltloom.sources.html import importable

STATE_VERSION = 1


def load_state(raw: str | None) -> dict:
    """Checked: an unknown version or a malformed state fails the query, and so publishes nothing."""
    if raw is None:
        return {"announced": set(), "names": {}}
    found = json.loads(raw)
    if found.get("version") != STATE_VERSION:
        raise ValueError(f"unsupported state version {found.get('version')}")
    if len(set(found["announced"])) != len(found["announced"]):
        raise ValueError("an identity is booked twice")
    return {"announced": set(found["announced"]), "names": dict(found["names"])}


def save_state(state: dict) -> str:
    return json.dumps({"version": STATE_VERSION, "announced": sorted(state["announced"]), "names": state["names"]}, sort_keys=True)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = load_state(state.get[0] if state.exists else None)
    rows = []
    whole = pd.concat(list(frames))
    for epoch, poll in whole.sort_values(["epoch", "ord"]).groupby("epoch", sort=True):
        items = [{"guid": g, "names": list(n) if n is not None else []} for g, n in zip(poll["guid"], poll["names"])]
        rows += [(key[0], epoch, i["guid"]) for i in decide_releases(now, items)]
    state.update((save_state(now),))
    yield pd.DataFrame(rows, columns=["source_id", "epoch", "guid"])


def announce_stream(observed: DataFrame) -> DataFrame:
    """A streaming frame (source_id, epoch, ord, guid, names) to one of announcements."""
    importable(observed.sparkSession)
    rows = observed.selectExpr("source_id", "epoch", "ord", "guid", "names as names_")
    rows = rows.withColumnRenamed("names_", "names")
    return rows.groupBy("source_id").applyInPandasWithState(_fold, "source_id string, epoch bigint, guid string", "state string", "append", GroupStateTimeout.NoTimeout)
