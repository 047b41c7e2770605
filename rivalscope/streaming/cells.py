"""Cells that come late into open drafts: the merge by precedence as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merging import ORIGIN_RANK, SUGGESTION, TOP

SLOTS = 1 << 13  #: groups that keys are dealt to by hash: calling Python costs some milliseconds a group, however few cells it has
STATE = "held string"


def merge_stream(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, origin, conflicts, superseded) of each key that a batch changes, from a stream of cells (keys, seq, value, origin and, if there is one, source).

    A key's cells are taken in the order in which they come, those of one batch by ``seq``; the rules are those of ``merge_cells``, which
    gives the same if ``seq`` is that order.  The state of a key is one cell and two counters, however many cells come; those of a slot's
    keys lie together as JSON.  Blank values don't take part; a key without values has no row.
    """
    by = "source" if "source" in cells.columns else "origin"
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    key_types = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    dealt = cells.select(slot.alias("_slot"), F.to_json(F.struct(*keys), whole).alias("_key"), "seq", F.col("value").cast("string").alias("value"), "origin", F.col(by).alias("_by"))

    def fold(_slot: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        all_held = json.loads(state.get[0]) if state.exists else {}
        rows, touched = pd.concat(list(parts)).sort_values("seq", kind="stable"), {}
        for key, value, origin, source in zip(rows["_key"], rows["value"], rows["origin"], rows["_by"], strict=True):
            touched[key] = None
            if value is None or pd.isna(value) or not value.strip():
                continue
            rank, manual, held = ORIGIN_RANK.get(origin, 0), source == "manual", all_held.get(key)
            if held is None:
                all_held[key] = [value, origin if isinstance(origin, str) else None, TOP if manual else rank, manual, 0, 0]
            elif value != held[0] and origin != SUGGESTION:
                held[4 if held[3] else 5] += 1
                if rank > held[2]:
                    held[:4] = value, origin, TOP if manual else rank, manual
        if all_held:
            state.update((json.dumps(all_held),))
        changed = [(key, all_held[key][0], all_held[key][1], all_held[key][4], all_held[key][5]) for key in touched if key in all_held]
        if changed:
            yield pd.DataFrame(changed, columns=["_key", "value", "origin", "conflicts", "superseded"])

    merged = dealt.groupBy("_slot").applyInPandasWithState(fold, "_key string, value string, origin string, conflicts long, superseded long", STATE, "update", GroupStateTimeout.NoTimeout)
    return merged.select(F.from_json("_key", key_types, whole).alias("_k"), "value", "origin", "conflicts", "superseded").select(*(F.col("_k")[k].alias(k) for k in keys), "value", "origin", "conflicts", "superseded")
