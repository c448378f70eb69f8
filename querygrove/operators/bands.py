"""Rows that agree in some columns and lie within a width of each other in a value: a graph whose edges
grow with the square of such groups, worked on without them where an answer doesn't name them.

Degrees, sums over neighbours and components take a sort of each group; neighbours of some rows meet
only their own and the next bands; pairs are made in even slices, when they are read, and never stored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import slices

#: Pairs that a task looks at, about; and a group's rows on one side, beyond which they are dealt.
PAIRS_A_TASK, ROWS_A_SIDE = 4_000_000, 2_000


def within(values: np.ndarray, weights: np.ndarray, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted values differ from each of `at` by width at most, and their weights' sum."""
    d, first = np.unique(values, return_index=True)
    first = np.append(first, len(values))
    lo, hi = np.searchsorted(d, at - width, "left"), np.searchsorted(d, at + width, "right")
    if len(d):  # sums round, so the borders are set by differences, as in a join
        last = len(d) - 1
        while (m := (hi <= last) & (d[np.minimum(hi, last)] - at <= width)).any():
            hi = hi + m
        while (m := (hi > 0) & (d[np.maximum(hi - 1, 0)] - at > width)).any():
            hi = hi - m
        while (m := (lo > 0) & (at - d[np.maximum(lo - 1, 0)] <= width)).any():
            lo = lo - m
        while (m := (lo <= last) & (at - d[np.minimum(lo, last)] > width)).any():
            lo = lo + m
    begin, end = first[lo], first[np.maximum(hi, lo)]
    run = np.concatenate([[0.0], np.cumsum(weights)])
    return end - begin, run[end] - run[begin]


class Band:
    """rows(key, *same, value); rows with a null among these, or a value that isn't finite, pair with none."""

    def __init__(self, rows: DataFrame, key: str, same: list[str], value: str, width: float) -> None:
        self.key, self.same, self.value, self.width = key, same, value, width
        v = F.col(value).cast("double")
        self.rows = rows.dropna(subset=[key, *same, value]).where(~F.isnan(v) & (F.abs(v) < float("inf")))

    def over(self, rows: DataFrame) -> Band:
        """The same graph over other rows, which may have further columns."""
        return Band(rows, self.key, self.same, self.value, self.width)

    @property
    def _band(self):
        return F.floor(F.col(self.value) / self.width)

    @cached_property
    def size(self) -> tuple[int, int, int]:
        """Rows, pairs within a band and to the next (all of them), and the rows of the largest band."""
        n = self.rows.groupBy(*self.same, self._band.alias("band")).agg(F.count("*").alias("n"))
        rows, pairs, most = n.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")), F.max("n")).first()
        return rows or 0, int(2 * (pairs or 0)), most or 0

    @cached_property
    def unique(self) -> bool:
        """Whether no key occurs twice, so that sums over rows are sums over nodes."""
        return self.rows.groupBy(self.key).count().where("count > 1").isEmpty()

    def pairs(self, *extra: str) -> DataFrame:
        """(a, b), a < b, and further columns of both ends, as a_ and b_, for each pair of rows. A row
        meets its own and the next band; rows of a large band are dealt, so no task has one alone."""
        rows, pairs, most = self.size
        parts = min(100_000, max(slices(self.rows.sparkSession, rows), -(-pairs // PAIRS_A_TASK)))
        deal = max(1, -(-most // ROWS_A_SIDE))
        side = lambda end: [F.col(self.key).alias(f"{end}__k"), F.col(self.value).alias(f"{end}__v"), *(F.col(c).alias(f"{end}_{c}") for c in extra)]
        left = self.rows.select(*self.same, *side("x"), self._band.alias("own"), F.explode(F.array(self._band, self._band + 1)).alias("band"), F.pmod(F.xxhash64(self.key), F.lit(deal)).alias("deal"))
        right = self.rows.select(*self.same, *side("y"), self._band.alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))).alias("deal"))
        on = [*self.same, "band", "deal"]
        near = left.repartition(parts, *on).join(right.repartition(parts, *on).hint("shuffle_hash"), on)
        near = near.where(F.abs(F.col("x__v") - F.col("y__v")) <= self.width)
        # each unordered pair once: within a band by key, across bands from the lower one
        near = near.where((F.col("x__k") < F.col("y__k")) | ((F.col("own") < F.col("band")) & (F.col("x__k") != F.col("y__k"))))
        first = F.col("x__k") < F.col("y__k")
        swap = lambda p, q, name: F.when(first, F.col(p)).otherwise(F.col(q)).alias(name)
        return near.select(F.least("x__k", "y__k").alias("a"), F.greatest("x__k", "y__k").alias("b"), *(swap(f"x_{c}", f"y_{c}", f"a_{c}") for c in extra), *(swap(f"y_{c}", f"x_{c}", f"b_{c}") for c in extra))

    def sums(self, weights: DataFrame | None = None) -> DataFrame:
        """(key, n, s): of the other rows that a row pairs with, those that weights(key, weight) has,
        all with weight 1 without weights: how many, and their weights' sum. Rows with none are left
        out. Needs unique keys."""
        kind = dict(self.rows.dtypes)[self.key]
        r = self.rows.select(self.key, *self.same, F.col(self.value).cast("double").alias("__v"), self._band.alias("__b"))
        r = r.withColumn("__w", F.lit(1.0)) if weights is None else r.join(weights.select(self.key, F.col("weight").alias("__w")), self.key, "left")
        b = F.col("__b")
        near = F.when(F.col("__w").isNull(), F.array(b)).otherwise(F.array(b - 1, b, b + 1))
        r = r.select(self.key, *self.same, "__v", "__w", b.alias("__b"), F.explode(near).alias("__unit"))
        names, same, width = [self.key, "n", "s"], self.same, self.width

        def go(batches):
            got = [p for p in batches if len(p)]
            if not got:
                return
            pdf = pd.concat(got, ignore_index=True)
            group = pdf.groupby([*same, "__unit"], sort=False).ngroup().to_numpy()
            order = np.lexsort((pdf["__v"].to_numpy(), group))
            key, group = pdf[names[0]].to_numpy()[order], group[order]
            v, w, own = pdf["__v"].to_numpy()[order], pdf["__w"].to_numpy(np.float64, na_value=np.nan)[order], (pdf["__b"] == pdf["__unit"]).to_numpy()[order]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                mine, data = own[lo:hi], ~np.isnan(w[lo:hi])
                if not mine.any() or not data.any():
                    continue
                n, s = within(v[lo:hi][data], w[lo:hi][data], v[lo:hi][mine], width)
                self_in = data[mine]
                n, s = n - self_in, np.maximum(s - np.where(self_in, w[lo:hi][mine], 0.0), 0.0)
                some = n > 0
                if some.any():
                    yield pd.DataFrame({names[0]: key[lo:hi][mine][some], "n": n[some], "s": s[some]})

        parts = slices(self.rows.sparkSession, 3 * self.size[0])
        return r.repartition(parts, *self.same, "__unit").mapInPandas(go, f"{self.key} {kind}, n long, s double")

    def chain(self) -> DataFrame:
        """(a, b) of rows that follow each other in a group and pair: the same components as all pairs."""
        w = W.partitionBy(*self.same).orderBy(self.value, self.key)
        e = self.rows.select(F.col(self.key).alias("a"), F.lead(self.key).over(w).alias("b"), (F.lead(self.value).over(w) - F.col(self.value)).alias("gap"))
        return e.where(F.col("gap") <= self.width).select("a", "b")

    def near(self, some: DataFrame) -> DataFrame:
        """some(key, ...) joined to the key of each row that it pairs with, as `other`."""
        own = some.join(self.rows.select(self.key, *self.same, F.col(self.value).alias("__v"), self._band.alias("__b")), self.key)
        own = own.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)))
        other = self.rows.select(*self.same, self._band.alias("__b"), F.col(self.key).alias("other"), F.col(self.value).alias("__o"))
        met = own.join(other, [*self.same, "__b"]).where((F.abs(F.col("__v") - F.col("__o")) <= self.width) & (F.col(self.key) != F.col("other")))
        return met.select(*some.columns, "other")
