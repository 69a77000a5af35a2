"""An inverted-file index over unit vectors: every vector in the cell of its nearest centre, searches probe the nearest cells.

Only the centres and the number of probes are fitted, on a bounded sample; every row is indexed. The exact search (:func:`lodestone.operators.retrieve.nearest`) is the
measure of its recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.retrieve import VECTOR_TOP, matrix_of, ranked
from lodestone.scale import in_blocks, over_blocks

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Recall at which the number of probes aims on the sample; queries of the sample that measure it.
RECALL, JUDGES = 0.93, 256


class Centres(NamedTuple):
    """The fitted part of an index: the cells' centres, and how many cells a search probes to keep ``RECALL`` of the sample's neighbours."""

    units: np.ndarray
    probes: int


def fit(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, rounds: int = 12, seed: int = 3, key: str = "vec_id", top: int = VECTOR_TOP) -> Centres:
    """Centres by spherical k-means over about ``sample`` vectors, picked by a hash of their key; at most twice that reach the driver.

    Without ``cells`` there are twice the square root of the number of vectors, so that a cell and the list of cells grow alike. How many of them must be
    probed depends on how far the vectors are clustered: it is measured on the sample, whose neighbours are known exactly.
    """
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    place = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000.0
    rows = vectors.filter(place < share).select("unit").orderBy(F.xxhash64(key)).limit(2 * sample).collect()
    points = np.array([r["unit"] for r in rows], dtype=np.float64)
    if not len(points):
        return Centres(np.zeros((0, 0)), 0)
    cells = min(cells or max(16, round(2 * n**0.5)), len(points))
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), cells, replace=False)]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    own = (points @ centres.T).argmax(axis=1)
    judges = points[rng.choice(len(points), min(JUDGES, len(points)), replace=False)]
    near = np.argsort(-(judges @ points.T), axis=1, kind="stable")[:, : top]
    turn = np.argsort(np.argsort(-(judges @ centres.T), axis=1, kind="stable"), axis=1)  # the turn at which a cell is probed
    turns = np.take_along_axis(turn, own[near], axis=1).ravel()
    return Centres(centres, int(np.quantile(turns, RECALL, method="higher")) + 1)


def to_table(spark: SparkSession, centres: Centres) -> DataFrame:
    """``(cell, unit, probes)``, as it is stored beside the vectors."""
    rows = [(i, [float(x) for x in u], centres.probes) for i, u in enumerate(centres.units)]
    return spark.createDataFrame(rows, "cell int, unit array<double>, probes int")


def from_table(table: DataFrame) -> Centres:
    """The stored centres: twice the square root of the vectors' number, so a few thousand for billions of them."""
    rows = table.orderBy("cell").collect()
    return Centres(np.array([r["unit"] for r in rows]), rows[0]["probes"]) if rows else Centres(np.zeros((0, 0)), 0)


def build(vectors: DataFrame, centres: Centres, key: str = "vec_id") -> DataFrame:
    """``(cell, key, unit)`` of every vector; written with ``partitionBy("cell")`` a search reads the probed cells only."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres.units)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                cell = (matrix_of(piece.column(1)) @ shared.value.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), piece.column(0), piece.column(1)], names=["cell", key, "unit"])

    return vectors.select(key, "unit").mapInArrow(run, f"cell int, {key} {kind}, unit array<double>")


def search(
    queries: DataFrame, index: DataFrame, centres: Centres, probes: int | None = None, top: int = VECTOR_TOP, key: str = "vec_id", block: int = 2000, block_bytes: int = 64 << 20
) -> DataFrame:
    """``(qid, key, score, rank)`` of the best ``top`` vectors in the ``probes`` cells nearest to each query, by default as many as were fitted.

    Queries ``(qid, unit)`` are held in blocks of at most ``block`` and ``block_bytes`` bytes, as in the exact search; a row is compared only with the
    queries that probe its cell, so the work is about ``probes`` / cells of the exact one. No pairs are emitted: every partition keeps each query's best.
    """
    types = (queries.schema["qid"].dataType.simpleString(), index.schema[key].dataType.simpleString())
    schema = f"qid {types[0]}, {key} {types[1]}, score double"
    probes = centres.probes if probes is None else probes

    def over(shared: Broadcast) -> DataFrame:
        def asked_of(matrix: np.ndarray) -> dict[int, np.ndarray]:
            near = np.argsort(-(matrix @ centres.units.T), axis=1, kind="stable")[:, :probes]
            return {int(c): np.nonzero((near == c).any(axis=1))[0] for c in np.unique(near)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = [q for q, _ in shared.value], np.vstack([u for _, u in shared.value])
            asked = asked_of(matrix)
            held: list[list] = [[] for _ in ids]
            for batch in batches:
                cells = batch.column(0).to_numpy(zero_copy_only=False)
                for cell in np.unique(cells):
                    mine = asked.get(int(cell))
                    if mine is None:
                        continue
                    rows = batch.take(pa.array(np.nonzero(cells == cell)[0]))
                    names = rows.column(1).to_pylist()
                    scores = np.maximum(0.0, 1 - (1 - matrix_of(rows.column(2)) @ matrix[mine].T) / 2)
                    for k, j in enumerate(mine):
                        col = scores[:, k]
                        edge = np.partition(col, -top)[-top] if len(col) > top else -1.0
                        held[j] = sorted(held[j] + [(-col[i], names[i]) for i in np.nonzero(col >= edge)[0]])[:top]
            out = [(q, n, -s) for q, best in zip(ids, held, strict=True) for s, n in best]
            if out:
                q, n, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, _ARROW[types[0]]), pa.array(n, _ARROW[types[1]]), pa.array(s, pa.float64())], names=["qid", key, "score"])

        wanted = index.filter(F.col("cell").isin(*asked_of(np.vstack([u for _, u in shared.value]))))
        return wanted.select("cell", key, "unit").mapInArrow(run, schema)

    told = ((r["qid"], np.array(r["unit"])) for r in queries.select("qid", "unit").toLocalIterator())
    found = over_blocks(index.sparkSession, in_blocks(told, block, block_bytes, lambda x: x[1].nbytes), over)
    return ranked(index.sparkSession.createDataFrame([], schema) if found is None else found, key=key, top=top)
