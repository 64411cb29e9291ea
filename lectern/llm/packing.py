"""Filling fixed-capacity containers by bounded-space online best fit.

Items of a shard arrive one after the other. Open containers are kept in a bitset keyed by free space: the best fit of an
item is the lowest set bit at or above its size. When nothing fits and all places are taken, the fullest container,
which is the lowest set bit, is closed.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = 256
SHARD_ITEMS = 50_000


class OpenContainers:
    """At most ``places`` open containers of ``capacity``; ``put`` gives the number of the container that takes an item."""

    def __init__(self, capacity: int, places: int) -> None:
        self.capacity, self.places = capacity, places
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def put(self, size: int) -> int:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.fresh()
        if free > size:
            self.by_free.setdefault(free - size, deque()).append(number)
            self.bits |= 1 << (free - size)
            self.open += 1
        return number

    def fresh(self) -> int:
        self.made += 1
        return self.made - 1

    def _take(self, free: int) -> int:
        numbers = self.by_free[free]
        number = numbers.popleft()
        if not numbers:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack_shard(sizes: np.ndarray, capacity: int, separator: int, places: int) -> tuple[np.ndarray, ...]:
    """For each placed piece: index of its item, piece number from 1, first token, tokens, container."""
    room = capacity - separator
    containers = OpenContainers(capacity, places)
    item, piece, first, tokens, container = [], [], [], [], []
    for index, size in enumerate(sizes.tolist()):
        start, number = 0, 0
        while size - start > room or (number == 0 and size > 0) or start < size:
            part = min(room, size - start)
            number += 1
            # A full part of a divided item fills a container alone.
            where = containers.fresh() if part == room else containers.put(part + separator)
            item.append(index), piece.append(number), first.append(start), tokens.append(part), container.append(where)
            start += part
    return tuple(np.array(x, dtype=np.int64) for x in (item, piece, first, tokens, container))


def pack(
    items: DataFrame, budgets: list[tuple[int, int, int]], key: str, tokens: str = "tokens", shards: int = 1, places: int = OPEN
) -> DataFrame:
    """Which item lies in which container, for every ``(budget_id, capacity_tokens, separator_tokens)`` of ``budgets``.

    Rows: ``budget_id``, ``container`` (unique within the budget), ``key``, ``piece_no`` from 1, ``token_start`` and
    ``tokens`` of the piece. A container's pieces and one separator after each never exceed the capacity. An item is
    divided only if it and its separator alone exceed the capacity; its full parts then have a container each and the
    rest is placed like an item. Repeated rows are items of their own.

    Items with a null or non-positive size take no space and are in no container. A null key stays null. No items, or no
    budgets, give no rows. Columns other than the key and the size are ignored.

    Items are spread over ``shards`` by a hash of their key and size, independently of Spark's partitioning, and taken in
    the order of that hash; repeated rows are counted first and numbered, so that they are spread too. Each shard and budget is packed on its own by one task, which holds ``places`` open
    containers. Choose ``shards`` so that each has about ``SHARD_ITEMS`` items: see ``shards_for``. The unused space
    that the shards add is at most ``places`` containers each.
    """
    for budget, capacity, separator in budgets:
        if capacity <= separator:
            raise ValueError(f"budget {budget}: a capacity of {capacity} has no room beside a separator of {separator}")
    schema = f"budget_id int, container long, `{key}` {dict(items.dtypes)[key]}, piece_no int, token_start long, tokens long"
    if not budgets:
        return items.sparkSession.createDataFrame([], schema)

    def place(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        budget, capacity, separator, shard = (int(x) for x in group)
        rows = rows.sort_values(["_hash", "_key", "_size"], kind="stable").reset_index(drop=True)
        item, piece, first, size, container = pack_shard(rows["_size"].to_numpy(), capacity, separator, places)
        return pd.DataFrame(
            {"budget_id": budget, "container": (shard << 32) + container, key: rows["_key"].to_numpy()[item], "piece_no": piece, "token_start": first, "tokens": size}
        ).astype({"budget_id": "int32", "piece_no": "int32"})

    each = F.explode(F.array(*[F.struct(*[F.lit(int(x)).alias(n) for x, n in zip(b, "ics")]) for b in budgets]))
    counted = items.filter(F.col(tokens) > 0).groupBy(F.col(key).alias("_key"), F.col(tokens).cast("long").alias("_size")).agg(F.count("*").alias("_n"))
    return (
        counted.select("_key", "_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"))
        .select("_key", "_size", F.xxhash64("_key", "_size", "_i").alias("_hash"))
        .select("*", each.alias("_b"))
        .groupBy(F.col("_b.i").alias("_i"), F.col("_b.c").alias("_c"), F.col("_b.s").alias("_s"), F.pmod(F.shiftright("_hash", 7), F.lit(shards)).alias("_shard"))
        .applyInPandas(place, schema)
    )


def shards_for(items: int, each: int = SHARD_ITEMS) -> int:
    return max(1, -(-items // each))


def fill(placed: DataFrame, budgets: list[tuple[int, int, int]]) -> DataFrame:
    """For each budget: the containers used, the fewest that the tokens could need, and the share of space in use."""
    by_container = placed.groupBy("budget_id", "container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    sums = by_container.groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    capacity = F.create_map(*[F.lit(int(x)) for b in budgets for x in (b[0], b[1])])[F.col("budget_id")]
    separator = F.create_map(*[F.lit(int(x)) for b in budgets for x in (b[0], b[2])])[F.col("budget_id")]
    used = F.col("tokens") + F.col("pieces") * separator
    return sums.select(
        "budget_id", "containers", F.ceil(used / capacity).alias("fewest_containers"), "pieces", "tokens", F.round(used / (F.col("containers") * capacity), 6).alias("filled")
    )
