"""Filling containers of fixed capacity along a space-filling curve."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.shared import written
from skyledger.llm.tokens import TOKENIZERS, measure

#: Bits of each coordinate of the curve.
BITS = 10
#: Neighbouring items along the curve that are packed at a time; the more, the less alike are a container's items.
WINDOW = 64
#: Containers filled to this part are closed; the items of the others are packed again with the next neighbours.
FULL = 0.995
#: Items that wait for neighbours, at most; beyond it all their containers are closed.
WAITING = 1024
#: Items of a partition, about.
PER_PARTITION = 50_000


def hilbert(xyz: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates of ``bits`` bits (rows of ``xyz``)."""
    x = [xyz[:, i].astype(np.int64) for i in range(xyz.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> b) & 1)
    return key


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: containers as lists of item numbers, no container above ``capacity``."""
    open_: list[tuple[int, int]] = []  # (space left, container)
    out: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect_left(open_, (n, -1))
        if k < len(open_):
            left, c = open_.pop(k)
        else:
            left, c = capacity, len(out)
            out.append([])
        out[c].append(i)
        if left > n:
            insort(open_, (left - n, c))
        elif left == n == 0:
            insort(open_, (0, c))
    return out


def pack(sized: DataFrame, key: str, size: str, curve: str, capacity: int, window: int = WINDOW, per_partition: int = PER_PARTITION) -> DataFrame:
    """(key, piece, n_tokens, container_id, place) of every row, packed among neighbours along ``curve``.

    Along the curve ``window`` items at a time are packed, together with those that wait, by best-fit decreasing; full
    containers are closed, and the items of the others wait for the next neighbours.

    An item longer than ``capacity`` is divided into full pieces and a rest, any other is piece 0. Items of size 0 take a
    place, too. Ties along the curve go by key. No rows: no containers.
    """
    full = F.floor(F.col(size) / capacity).cast("int")
    n_pieces = F.when(F.col(size) <= capacity, F.lit(1)).otherwise(full + (F.col(size) % capacity > 0).cast("int"))
    items = sized.select(curve, key, size, F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece")).select(
        curve, key, "piece", F.least(F.col(size) - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("int").alias("n_tokens")
    )
    parts = max(1, round(sized.count() / per_partition))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        waiting: pd.DataFrame | None = None

        def closed(df: pd.DataFrame, least: float) -> tuple[pd.DataFrame, pd.DataFrame]:
            nonlocal first
            sizes = df["n_tokens"].to_numpy()
            bins = best_fit(sizes, capacity)
            keep = [b for b in bins if sizes[b].sum() >= least]
            left = sorted(i for b in bins if sizes[b].sum() < least for i in b)
            count = sum(map(len, keep))
            where = np.fromiter((c for c, b in enumerate(keep) for _ in b), np.int64, count)
            place = np.fromiter((p for b in keep for p in range(len(b))), np.int32, count)
            done = df.iloc[np.fromiter((i for b in keep for i in b), np.int64, count)]
            done = done.assign(container_id=first + where, place=place)[[key, "piece", "n_tokens", "container_id", "place"]]
            first += len(keep)
            return done, df.iloc[left]

        for f in frames:
            out = []
            for at in range(0, len(f), window):
                df = f.iloc[at : at + window]
                if waiting is not None and len(waiting):
                    df = pd.concat([waiting, df], ignore_index=True)
                done, waiting = closed(df, FULL * capacity if len(df) <= WAITING else 0)
                out.append(done)
            if out:
                yield pd.concat(out, ignore_index=True)
        if waiting is not None and len(waiting):
            yield closed(waiting, 0)[0]

    kind = sized.schema[key].dataType.simpleString()
    ordered = items.repartitionByRange(parts, curve, key, "piece").sortWithinPartitions(curve, key, "piece")
    return ordered.mapInPandas(work, f"{key} {kind}, piece int, n_tokens int, container_id long, place int")


def curve_keys(measured: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(key, n_tokens, curve): three coordinates, about normally distributed, cut to [-4, 4], as a place on the curve."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            grid = np.clip((f[["x", "y", "z"]].to_numpy() + 4) / 8 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            yield f[[key, "n_tokens"]].assign(curve=hilbert(grid, bits))

    return measured.mapInPandas(work, f"{key} {measured.schema[key].dataType.simpleString()}, n_tokens long, curve long")


def pack_documents(docs: DataFrame, key: str, text: str, capacity: int = 2048, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents, sized in tokens, into containers, similar documents in the same ones."""
    sized = written(curve_keys(measure(docs, key, text, tokenizers=tokenizers), key), "sized")
    return pack(sized, key, "n_tokens", "curve", capacity)
