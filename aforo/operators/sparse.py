"""Sums of products over designs of dummies and numbers, without rows as wide as the design.

A row reaches Python as its numbers and the raw values of its categorical
columns. A dummy is then a position, so products of dummies are counts, products
of a dummy with a number are sums by position, and only number with number is a
matrix product. A task gives one k x k matrix, whatever it read.

Clustered sums: rows are shuffled by cluster once, narrow, and come sorted, so a
cluster is a stretch of rows whose sums are added up and squared at once; a
stretch may go over many Arrow batches. A cluster known to be hot is dealt to many
tasks instead, each of which gives its k sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a task's clusters x terms array.
MOST_CELLS = 2_000_000
ENTRIES = "hot string, i int, j int, v double"


@dataclass(frozen=True)
class Design:
    """Positions of the terms: constants, number columns, and per categorical column its levels."""

    k: int
    constants: list[int]
    numbers: list[int]
    blocks: list[tuple[str, list, list[int]]]

    @classmethod
    def of(cls, terms: Sequence) -> Design:
        found: dict[str, tuple[list, list[int]]] = {}
        constants, numbers = [], []
        for i, t in enumerate(terms):
            if t.source is not None:
                levels, places = found.setdefault(t.source, ([], []))
                levels.append(t.level)
                places.append(i)
            else:
                (constants if t.constant else numbers).append(i)
        return cls(len(terms), constants, numbers, [(c, *found[c]) for c in found])

    def columns(self, terms: Sequence) -> list[Column]:
        """What Python needs of a row."""
        numbers = [terms[i].centred().cast("double").alias(f"n{i}") for i in self.numbers]
        return numbers + [F.col(c).alias(f"b{b}") for b, (c, _, _) in enumerate(self.blocks)]

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        """Constants and numbers as a matrix, and per block the position within it, -1 for none."""
        n = batch.num_rows
        dense = np.ones((n, len(self.constants) + len(self.numbers)))
        for j, i in enumerate(self.numbers, len(self.constants)):
            dense[:, j] = as_floats(batch, f"n{i}")
        places = []
        for b, (_, levels, _) in enumerate(self.blocks):
            column = batch.column(f"b{b}")
            found = pc.index_in(column, value_set=pa.array(levels, type=column.type))
            places.append(pc.fill_null(found, -1).to_numpy(zero_copy_only=False))
        return dense, places

    @property
    def dense_places(self) -> np.ndarray:
        return np.array(self.constants + self.numbers, dtype=int)


def as_floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def _entries(total: np.ndarray, hot: str | None = None) -> pa.RecordBatch:
    """The entries of an upper triangle that are not zero."""
    i, j = np.nonzero(np.triu(total))
    names = pa.array([hot] * len(i), pa.string())
    return pa.RecordBatch.from_arrays(
        [names, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["hot", "i", "j", "v"]
    )


def _products(total: np.ndarray, design: Design, dense, places, w, s) -> None:
    """Add the products of a batch: terms with terms, and with the columns of weights and outcome sums."""
    k, at = design.k, design.dense_places
    weighted = dense * w[:, None]
    total[np.ix_(at, at)] += weighted.T @ dense
    total[at, k] += weighted.sum(axis=0)
    total[at, k + 1] += dense.T @ s
    for b, (_, levels, terms) in enumerate(design.blocks):
        terms, inside = np.array(terms), places[b] >= 0
        place, size = places[b][inside], len(levels)
        counts = np.bincount(place, weights=w[inside], minlength=size)
        total[terms, terms] += counts
        total[terms, k] += counts
        total[terms, k + 1] += np.bincount(place, weights=s[inside], minlength=size)
        for j, term in enumerate(at):
            sums = np.bincount(place, weights=weighted[inside, j], minlength=size)
            total[terms, term] += sums
            total[term, terms] += sums
        for c in range(b):
            both = inside & (places[c] >= 0)
            others = np.array(design.blocks[c][2])
            cells = np.bincount(places[b][both] * len(others) + places[c][both], weights=w[both], minlength=size * len(others))
            cells = cells.reshape(size, len(others))
            total[np.ix_(terms, others)] += cells
            total[np.ix_(others, terms)] += cells.T


def product_entries(rows: DataFrame, terms: Sequence, weight: Column, total: Column, squares: Column) -> DataFrame:
    """Entries (i, j, value) of the products of the terms and, after them, of weight, outcome sum and its squares.

    ``rows`` may be pooled: ``weight`` is the number of records of a row,
    ``total`` and ``squares`` are the sums of their outcome and of its square.
    """
    design = Design.of(terms)
    k = design.k

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 3, k + 3))
        for batch in batches:
            if batch.num_rows:
                w, s = as_floats(batch, "w"), as_floats(batch, "s")
                dense, places = design.read(batch)
                _products(out, design, dense, places, w, s)
                out[k, k] += w.sum()
                out[k, k + 1] += s.sum()
                out[k + 2, k + 2] += as_floats(batch, "q").sum()
        yield _entries(out)

    narrow = rows.select(*design.columns(terms), weight.alias("w"), total.alias("s"), squares.alias("q"))
    parts = narrow.mapInArrow(partial, ENTRIES)
    return parts.groupBy("i", "j").agg(F.sum("v").alias("value"))


def _new_cluster(batch: pa.RecordBatch, names: Sequence[str], before: tuple | None) -> np.ndarray:
    """True where a row's cluster differs from that of the row before."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for name in names:
        codes = pc.fill_null(batch.column(name).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = before is None or before != tuple(batch.column(c)[0].as_py() for c in names)
    return new


def _sums(design: Design, group, n_groups: int, dense, places, e) -> np.ndarray:
    """Sums of term x residual per group."""
    k = design.k
    out = np.zeros(n_groups * k)
    for j, term in enumerate(design.dense_places):
        out[term::k] = np.bincount(group, weights=dense[:, j] * e, minlength=n_groups)
    for (_, _, terms), place in zip(design.blocks, places, strict=True):
        inside = place >= 0
        out += np.bincount(group[inside] * k + np.array(terms)[place[inside]], weights=e[inside], minlength=n_groups * k)
    return out.reshape(n_groups, k)


def score_entries(
    rows: DataFrame, terms: Sequence, beta: np.ndarray, outcome: Column, cluster: Sequence[str], hot: Sequence[int] = ()
) -> DataFrame:
    """Entries (hot, i, j, value) of the sum over clusters of s s', s = sum of term x residual.

    After the terms come the number of clusters, at (k, k), and the squared
    residuals, at (k, k + 1). ``hot`` lists hashes (:func:`cluster_hash`) of
    clusters that are dealt out; each of them comes as its own entries (i, i),
    which are the sums themselves.
    """
    design = Design.of(terms)
    k, at = design.k, design.dense_places
    step = max(256, MOST_CELLS // max(k, 1))
    keys = [f"c{i}" for i in range(len(cluster))]
    per_block = [np.append(beta[np.array(ts, dtype=int)], 0.0) for _, _, ts in design.blocks]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, tail, before = np.zeros((k + 2, k + 2)), np.zeros(k), None
        named: dict[str, np.ndarray] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                dense, places = design.read(batch)
                e = as_floats(batch, "y") - dense @ beta[at]
                for coefficients, place in zip(per_block, places, strict=True):
                    e -= coefficients[place]  # -1 is the appended zero
                out[k, k + 1] += e @ e
                names = batch.column("hot")
                for name in pc.unique(names).to_pylist():
                    if name is not None:
                        mine = pc.fill_null(pc.equal(names, name), False).to_numpy(zero_copy_only=False)
                        one = _sums(design, np.zeros(mine.sum(), dtype=int), 1, dense[mine], [p[mine] for p in places], e[mine])
                        named[name] = named.get(name, 0) + one[0]
                if names.null_count == 0:
                    continue
                cold = pc.is_null(names).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(cold))
                new = _new_cluster(batch, keys, before)
                sums = _sums(design, np.cumsum(new), new.sum() + 1, dense[cold], [p[cold] for p in places], e[cold])
                sums[0] += tail
                out[:k, :k] += sums[:-1].T @ sums[:-1]
                out[k, k] += new.sum()
                tail, before = sums[-1], tuple(batch.column(c)[-1].as_py() for c in keys)
        out[:k, :k] += np.outer(tail, tail)
        yield _entries(out)
        for name, one in named.items():
            yield _entries(np.diag(one), name)

    is_hot = cluster_hash(cluster).isin(list(hot)) if hot else F.lit(False)
    name = F.when(is_hot, F.to_json(F.struct(*cluster), {"ignoreNullFields": "false"}))
    narrow = rows.select(
        *[F.col(c).alias(k) for c, k in zip(cluster, keys, strict=True)], outcome.alias("y"), *design.columns(terms), name.alias("hot")
    )
    values = [c for c in narrow.columns if c not in (*keys, "hot")]
    salt = F.when(F.col("hot").isNotNull(), F.xxhash64(*values))
    dealt = narrow.repartition(*keys, salt).sortWithinPartitions(*keys)
    return dealt.mapInArrow(partial, ENTRIES).groupBy("hot", "i", "j").agg(F.sum("v").alias("value"))


def cluster_hash(cluster: Sequence[str]) -> Column:
    return F.xxhash64(*cluster)


def gather(entries: DataFrame, size: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The matrix on the driver, and the sums of each hot cluster; their size depends on the design only."""
    out, named = np.zeros((size, size)), {}
    for r in entries.collect():
        if "hot" in r and r["hot"] is not None:
            named.setdefault(r["hot"], np.zeros(size))[r["i"]] = r["value"]
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out, named
