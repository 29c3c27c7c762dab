"""Audit chains over entries that arrive as a stream: each log's last hash and count are its state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.messages import GENESIS

NAMES = ["at", "event", "payload_sha256"]


def _hash(seq: int, values: list[str]) -> str:
    raw = [x.encode("utf-8", "surrogatepass") for x in values]
    return hashlib.sha256(seq.to_bytes(8, "big", signed=True) + b"".join(len(x).to_bytes(8, "big") + x for x in raw)).hexdigest()


def chained(entries: DataFrame, key: str, order: str) -> DataFrame:
    """(key, seq, at, event, payload_sha256, prev, hash) of streamed entries (key, order, at, event, payload_sha256): each arrival goes on
    with its log's chain, those of one batch by ``order``. A log keeps its number of entries and last hash, whatever its length, so a
    restarted stream goes on where it was. A null breaks its log: no entry after it has a hash, as in the batch form."""
    kind = dict(entries.dtypes)[key]

    def run(log: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, GENESIS)
        rows = pd.concat(list(parts)).sort_values("__order", kind="stable")  # one log's arrivals of one batch
        seqs, prevs, hashes = [], [], []
        for values in zip(*[rows[x].tolist() for x in NAMES], strict=True):
            seqs.append(n)
            prevs.append(last)
            last = None if last is None or any(x is None for x in values) else _hash(n, [*values, last])
            hashes.append(last)
            n += 1
        state.update((n, last))
        yield pd.DataFrame({key: [log[0]] * len(rows), "seq": seqs, **{x: rows[x].tolist() for x in NAMES}, "prev": prevs, "hash": hashes})

    own = entries.select(key, F.col(order).alias("__order"), *[F.col(x).cast("string").alias(x) for x in NAMES])
    out = f"`{key}` {kind}, seq long, at string, event string, payload_sha256 string, prev string, hash string"
    return own.groupBy(key).applyInPandasWithState(run, out, "n long, last string", "append", GroupStateTimeout.NoTimeout)
