"""Filling containers of fixed capacity (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import cut, table

PACKED = "doc_id long, part int, start long, size int, container_id long"


class _Stock:
    """Items not yet packed, by size; finds the largest size that still fits."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], np.arange(capacity + 2))
        self.items = [order[cuts[s] : cuts[s + 1]].tolist() for s in range(capacity + 1)]
        there = np.array([s if self.items[s] and s else 0 for s in range(capacity + 1)])
        self.largest = np.maximum.accumulate(there)

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        if not self.items[size]:
            a, b = np.searchsorted(self.largest, (size, size + 1))
            self.largest[a:b] = self.largest[size - 1]
        return item

    def give(self, size: int, item: int) -> None:
        self.items[size].append(item)
        if self.largest[size] != size:
            b = np.searchsorted(self.largest, size + 1)
            self.largest[size:b] = size

    def two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """The two sizes with the largest sum within room, if it is above more_than."""
        a = np.unique(self.largest[: room + 1])
        a = a[(a > 0) & (a * 2 >= more_than - room)]
        if not len(a):
            return None
        b = self.largest[np.minimum(room - a, a)]
        alone = b == a
        if alone.any():
            single = np.array([len(self.items[x]) < 2 for x in a[alone]])
            at = np.flatnonzero(alone)[single]
            b[at] = self.largest[np.maximum(a[at] - 1, 0)]
        total = np.where(b > 0, a + b, 0)
        best = int(total.argmax())
        return (int(a[best]), int(b[best])) if total[best] > more_than else None


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item. Sizes are 1 to capacity.

    A container is filled greedily with the largest item that fits, until none does. Then its smallest item gives
    way to two unpacked items that together fill the widened gap more tightly, as long as there are such two.
    """
    out = np.empty(len(sizes), np.int64)
    stock, number = _Stock(sizes, capacity), 0
    while stock.largest[-1]:
        gap, inside = capacity, []
        while size := int(stock.largest[gap]):
            inside.append((size, stock.take(size)))
            gap -= size
        while gap and (pair := stock.two(gap + inside[-1][0], inside[-1][0])):
            size, item = inside.pop()
            gap += size
            for s in pair:
                inside.append((s, stock.take(s)))
                gap -= s
            stock.give(size, item)
            inside.sort(reverse=True)
        for _, item in inside:
            out[item] = number
        number += 1
    return out


def container_items(docs: DataFrame, capacity: int, tokens: str = "text") -> DataFrame:
    """One row per document, or per part of at most `capacity` tokens where a document alone exceeds it.

    A token is a byte of the UTF-8 text. Null and empty texts have no tokens and make no item.
    """
    sized = docs.select("doc_id", F.octet_length(tokens).cast("long").alias("_n")).where("_n > 0")
    return sized.select("doc_id", "_n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(capacity).cast("long"))).alias("part", "start")).select(
        "doc_id", "part", "start", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("start")).cast("int").alias("size")
    )


def pack(items: DataFrame, capacity: int, group_rows: int = 8_000) -> DataFrame:
    """Items with the container each goes into.

    Items are spread by hash over groups of about `group_rows`, and each group is packed by itself, so neither one
    task nor the driver holds all; a group wastes at most its last few containers. Repeated items (rows equal in
    doc_id and part) are packed as often as they appear.
    """
    items = cut(items)
    groups = max(1, -(-items.count() // group_rows))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "part"], ignore_index=True)
        number = best_two_fit(pdf["size"].to_numpy(), capacity)
        return pdf.assign(container_id=pdf["_group"].to_numpy().astype(np.int64) * (1 << 32) + number)[["doc_id", "part", "start", "size", "container_id"]]

    spread = items.withColumn("_group", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups)).cast("int"))
    return spread.repartitionByRange(groups, "_group").groupBy("_group").applyInPandas(one, PACKED)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens and the share of the capacity that is filled."""
    per = packed.groupBy("container_id").agg(F.sum("size").cast("long").alias("_n"), F.count("*").alias("_items"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("_items").alias("items"), F.sum("_n").alias("tokens"), F.max("_n").alias("fullest"),
        F.round(F.try_divide(F.sum("_n").cast("double"), F.count("*") * F.lit(capacity)), 6).alias("fill"),
    )


CAPACITY = 4096


def p6_found(spark, folder):
    """Documents that had to be split because they alone exceed a container."""
    packed = pack(container_items(table(spark, folder, "documents", ["doc_id", "text"]), CAPACITY), CAPACITY)
    return packed.where("part = 1").select("doc_id")


def p6_containers(spark, folder):
    """Every document or part with its container."""
    return pack(container_items(table(spark, folder, "documents", ["doc_id", "text"]), CAPACITY), CAPACITY)


def p6_fill(spark, folder):
    """How full the containers are."""
    return fill_report(p6_containers(spark, folder), CAPACITY)
