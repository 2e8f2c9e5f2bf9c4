"""Whitening of embeddings by an exact covariance.

Entries become integers. Their sums per dimension are exact, and so is every deviation ``n * x - S``. Deviations are cut
into digits of ``DIGIT`` bits, which are small enough that float64 matrix products of up to ``ROWS`` rows are exact
integers. A task puts the products of its digits together as big integers, cuts each entry of its sum into digits of
``PART`` bits, and Spark adds those as longs; the driver then holds the exact sum of products over all rows: a matrix of
dimensions by dimensions, however many rows there are. Its quotient by ``n ** 3``, correctly rounded, is decomposed.

Data are read three times in narrow stages (sums, products, projections); nothing is shuffled but the digits of sums.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left out; an empty vector or a short
one counts as filled up with zeros to the longest; repeated rows count as often as they occur and are all returned; without
rows, or with vectors that are all empty, the result is empty. A component without variance (below ``FLAT`` of the whole)
has ``whitened`` 0 and takes no part in ``identity_error``; without any variance ``explained`` is 0. A null id stays null.
Entries of 2**52 or more don't fit the integers and raise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import scratch

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: 2 * DIGIT bits a product and 13 bits of rows are the 53 bits of a double.
DIGIT, ROWS = 20, 1 << 13
PART = 30
FLAT = 1e-13
_LEAST, _MOST = -(1 << 62), 1 << 62


def finite(e) -> F.Column:
    """Whether a vector is there and all its entries are numbers."""
    x = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return e.isNotNull() & ~F.coalesce(F.exists(e, x), F.lit(False))


def integers(vectors: DataFrame, scale: int, shift: int, column: str = "embedding") -> F.Column:
    return F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))


def digits(x: np.ndarray, number: int, bits: int = DIGIT) -> list[np.ndarray]:
    """``x`` as ``sum(d << (bits * k))``: all digits but the last are 0 or more, the last has the sign. Takes int64 or big integers."""
    out, mask = [], (1 << bits) - 1
    for _ in range(number - 1):
        out.append((x & mask).astype(np.int64))
        x = x >> bits
    return [*out, x.astype(np.int64)]


def together(parts: dict[int, np.ndarray] | list[np.ndarray], bits: int) -> np.ndarray:
    """The big integers whose digits these are; digits may be of any size."""
    items = parts.items() if isinstance(parts, dict) else enumerate(parts)
    return sum((p.astype(object) << (bits * k) if k else p.astype(object)) for k, p in items)


def _matrix(batch: pa.RecordBatch, dims: int, fill: int) -> np.ndarray:
    """Vectors as rows of int64, filled up to ``dims``."""
    lists = batch.column("x")
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.full((len(size), dims), fill, np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _sums(fill: int):
    """``(place, digit, value)``: sums of digits by dimension; place -1 has rows, -2 the largest magnitude, -3 dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, most = np.zeros((0, 4), np.int64), 0, 0
        for part in _blocks(batches):
            size = part.column("x").value_lengths().to_numpy(zero_copy_only=False)
            x = _matrix(part, int(size.max()), fill)
            if x.shape[1] > len(total):  # what came before counts as filled up
                new = np.array([d * rows for d in digits(np.array([fill]), 4)]).ravel()
                total = np.concatenate([total, np.tile(new, (x.shape[1] - len(total), 1))])
            total[: x.shape[1]] += np.stack([d.sum(0) for d in digits(x, 4)], axis=1)
            total[x.shape[1] :] += np.array([d * len(x) for d in digits(np.array([fill]), 4)]).ravel()
            rows, most = rows + len(x), max(most, int(np.abs(x).max(initial=0)))
        if rows:
            place, digit = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(place.ravel(), [-1, -2, -3])), pa.array(np.append(digit.ravel(), [len(total), 0, 0])), pa.array(np.append(total.ravel(), [rows, most, len(total)]))], names=["place", "digit", "value"]
            )

    return run


class Fit(NamedTuple):
    rows: int
    sums: np.ndarray  # big integers
    #: A bound of |n * x - S|.
    most: int

    @property
    def wide(self) -> bool:
        return self.most >= _MOST

    @property
    def number(self) -> int:
        """Digits of a deviation."""
        return self.most.bit_length() // DIGIT + 1

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` as int64, or as big integers where those are too small."""
        return x.astype(object) * self.rows - self.sums if self.wide else x * self.rows - self.sums.astype(np.int64)


def _fit(rows: DataFrame, fill: int) -> Fit:
    parts = rows.mapInArrow(_sums(fill), "place long, digit long, value long").groupBy("place", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("sum"), F.max("value").alias("most"))
    parts = parts.collect()  # four longs for each dimension
    # A task that saw short vectors only has no sums beyond their length: its rows are filled up here.
    counts = {r["digit"]: int(r["sum"]) for r in parts if r["place"] == -1}
    n = sum(counts.values())
    dims, most = (max((int(r["most"]) for r in parts if r["place"] == k), default=0) for k in (-3, -2))
    sums = [fill * sum(c for have, c in counts.items() if have <= d) for d in range(dims)]
    for r in parts:
        if r["place"] >= 0:
            sums[r["place"]] += int(r["sum"]) << (DIGIT * r["digit"])
    return Fit(n, np.array(sums, object), 2 * n * max(most, abs(fill)))


def _products(fit: Fit, fill: int):
    """``(entry, part, value)``: the sum of products of this task's deviations, the upper triangle by rows."""
    dims, number = len(fit.sums), fit.number
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _blocks(batches):
            d = [x.astype(np.float64) for x in digits(fit.deviations(_matrix(part, dims, fill)), number)]
            sums: dict[int, np.ndarray] = {}
            for a in range(number):
                for b in range(a, number):
                    p = (d[a].T @ d[b]).astype(np.int64)  # exact: below 2**53
                    p = p if a == b else p + p.T
                    sums[a + b] = sums[a + b] + p if a + b in sums else p
            whole = together({k: p[upper] for k, p in sums.items()}, DIGIT)
            total = whole if total is None else total + whole
        if total is not None:
            cut = max(int(abs(x)) for x in total).bit_length() // PART + 1
            parts = digits(total, cut, PART)
            entry = np.tile(np.arange(len(total)), cut)
            yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(np.repeat(np.arange(cut), len(total))), pa.array(np.concatenate(parts))], names=["entry", "part", "value"])

    return run


def products(rows: DataFrame, fit: Fit, fill: int = SHIFT) -> np.ndarray:
    """The exact sum over all rows of ``d d'`` for deviations ``d``: big integers, dimensions by dimensions."""
    parts = rows.mapInArrow(_products(fit, fill), "entry long, part long, value long").groupBy("entry", "part").agg(F.sum("value").alias("value")).collect()
    dims = len(fit.sums)
    flat = np.zeros(dims * (dims + 1) // 2, object)
    for r in parts:
        flat[r["entry"]] += r["value"] << (PART * r["part"])
    out = np.zeros((dims, dims), object)
    out[np.triu_indices(dims)] = flat
    return np.where(np.tri(dims, k=-1, dtype=bool), out.T, out)


def components(whole: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors as columns, and the trace of ``whole / n ** 3``; signs: the largest entry is positive."""
    cube = n**3
    v = np.array([[x / cube for x in row] for row in whole], float)  # quotients of integers, correctly rounded
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[top, np.arange(len(top))] < 0, -1.0, 1.0), sum(int(x) for x in whole.diagonal()) / cube


def _squares(d: np.ndarray, fit: Fit) -> list[int]:
    """The exact sum of squares of each row."""
    if d.shape[1] * fit.most**2 < _MOST:
        return (d * d).sum(1).tolist()
    cut = digits(d, fit.number)
    sums: dict[int, np.ndarray] = {}
    for a in range(fit.number):
        for b in range(a, fit.number):
            p = (cut[a] * cut[b]).sum(1) * (1 if a == b else 2)
            sums[a + b] = sums[a + b] + p if a + b in sums else p
    return together(sums, DIGIT).tolist()


def _projected(fit: Fit, vectors: np.ndarray, scale: np.ndarray, fill: int):
    dims, width = len(fit.sums), vectors.shape[1]
    bound = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            d = fit.deviations(_matrix(part, dims, fill))
            w = d.astype(np.float64) @ vectors * scale
            squares = [Decimal(s) if s < bound else None for s in _squares(d, fit)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(w).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(squares, pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    return run


SCHEMA = "vec_id long, deviation decimal(38,0), whitened array<double>, n long, explained array<double>, identity_error double"


def whitened(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(vec_id, deviation, whitened, n, explained, identity_error)``: one row a vector, up to ``most`` components in arrays.

    ``deviation`` is exact up to 38 digits and null beyond. ``identity_error`` is measured on the rows: the covariance of
    ``whitened`` over all of them, centred, against the identity.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(vectors, scale, shift).alias("x"))
    fit = _fit(rows, shift)
    if not fit.rows or not len(fit.sums):
        return spark.createDataFrame([], SCHEMA)
    values, axes, trace = components(products(rows, fit, shift), fit.rows, most)
    live = values > FLAT * trace
    width = np.where(live, 1 / (fit.rows * np.sqrt(np.where(live, values, 1))), 0.0)
    # Scratch, as the measured error must be that of the rows returned.
    out = scratch(rows.mapInArrow(_projected(fit, axes, width, shift), "vec_id long, deviation decimal(38,0), whitened array<double>"), "whitened")
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values)) if live[i] and live[j]]
    error = 0.0
    if pairs:
        w = F.col("whitened")
        found = out.agg(*(F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))
    explained = [float(v / trace) if ok else 0.0 for v, ok in zip(values, live, strict=True)]
    return out.select("*", F.lit(fit.rows).cast("long").alias("n"), F.array(*map(F.lit, explained)).alias("explained"), F.lit(float(error)).alias("identity_error"))


def whitened_components(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component; a deviation that doesn't fit a long is null."""
    wide = whitened(vectors, most)
    long = wide.select("vec_id", "deviation", "n", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )
