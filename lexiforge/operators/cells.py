"""R-3 over a stored vector index: exact inner-product top-k that skips.

Build: centres are fitted on a bounded sample, every vector goes to its nearest centre,
and each cell is written in blocks of vectors with like distance from the centre. A block
states that distance's range and its largest norm.

Search: the cells nearest a query give it a first k-th score; a cell or block is read only
if some query's bound reaches that score. With ``d = |q - c|`` and a block of distances
``near..far`` and norms up to ``m``, an inner product is at most the less of
``q.c + |q| far`` and ``(|q|^2 + m^2 - max(0, d - far, near - d)^2) / 2``. So results equal
those of ``dense_search``; only the work depends on how the vectors cluster (vectors spread
evenly in many dimensions let nothing be skipped).

Defined results: rows with a null id, a null or empty vector or a null or non-finite component take
no part, on either side; repeated ids and queries are each a row; an empty index or
batch gives no rows; a vector of another length raises; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiforge.operators.retrieval import SCORE_DIGITS, TILE_SCORES, _merge_top, top_k
from lexiforge.schemas import DEFAULT_TOP_K
from lexiforge.session import materialize, ship_by_value
from lexiforge.versions import new_folder, publish, read_manifest

#: Centres are fitted on at most this many vectors and bytes, whatever the table's size.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
#: The centres travel to every task.
CENTRE_BYTES = 16 << 20
CELLS = 256
BLOCK_ROWS = 512
BLOCK_BYTES = 4 << 20
#: Query vectors held by a task at once; larger batches are cut into slices.
BATCH_BYTES = 16 << 20
ROUNDS = 8


@dataclass
class VectorIndex:
    blocks: DataFrame       # cell, near, far, norm, n, ids, vectors
    centres: np.ndarray     # (cells, dimensions)
    n_vectors: int
    path: str
    version: int


def _usable(df: DataFrame, id_col: str, embedding: str) -> DataFrame:
    """(id, vec) as doubles; an array that holds a null or non-finite component is left out."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.where(F.col(id_col).isNotNull() & F.col(embedding).isNotNull()).where((F.size(v) > 0) & ~bad)
            .select(F.col(id_col).alias("id"), v.alias("vec")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if not (col.value_lengths().to_numpy(zero_copy_only=False) == dim).all():
        raise ValueError(f"a vector has not {dim} components")
    return flat.reshape(len(col), dim)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def fit_centres(vectors: DataFrame, n: int, dim: int, cells: int = CELLS) -> np.ndarray:
    """k-means over a sample by hash (documented bounds ``SAMPLE_ROWS``, ``SAMPLE_BYTES``);
    copies of a vector count once, and the sample does not depend on partitioning."""
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    h = F.xxhash64("vec")
    share = min(1.0, 1.2 * rows / max(n, 1))
    sample = vectors.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec").distinct()
    col = sample.orderBy(h, "vec").limit(rows).toArrow().column("vec").combine_chunks()
    x = np.unique(_matrix(col, dim), axis=0)
    k = max(1, min(cells, CENTRE_BYTES // (8 * dim), len(x) // 8))
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=k)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _assign_fn(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, TILE_SCORES // len(centres))
            for at in range(0, b.num_rows, step):
                s = b.slice(at, step)
                x = _matrix(s.column(1), centres.shape[1])
                cell = _nearest(x, centres)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(cell.astype(np.int32)),
                     pa.array(np.linalg.norm(x - centres[cell], axis=1)), pa.array(np.linalg.norm(x, axis=1))],
                    ["id", "vec", "cell", "dist", "norm"])
    return run


def _blocks_fn(dim: int, rows: int):
    """Sorted (id, vec, cell, dist, norm) rows into blocks of one cell and at most ``rows`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def blocks(t: pa.Table, last: bool):
            """Whole blocks of ``t`` and what is left for the next batch."""
            cell = t.column("cell").to_numpy()
            at, out = 0, []
            while at < len(cell):
                end = min(at + rows, at + int(np.searchsorted(cell[at:], cell[at], side="right")))
                if end == len(cell) and end - at < rows and not last:
                    break
                p = t.slice(at, end - at).combine_chunks()
                d = p.column("dist").to_numpy()
                vec = _matrix(p.column("vec").combine_chunks(), dim)
                out.append((int(cell[at]), float(d.min()), float(d.max()), float(p.column("norm").to_numpy().max()),
                            end - at, p.column("id").to_pylist(), np.ascontiguousarray(vec, "<f8").tobytes()))
                at = end
            return out, t.slice(at)

        def batch(out, id_type):
            c = list(zip(*out))
            types = [pa.int32(), *[pa.float64()] * 3, pa.int32(), pa.list_(id_type), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)],
                                              ["cell", "near", "far", "norm", "n", "ids", "vectors"])

        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            held.append(b)
            n += b.num_rows
            if n >= 4 * rows:
                out, rest = blocks(pa.Table.from_batches(held), False)
                if out:
                    yield batch(out, id_type)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield batch(blocks(pa.Table.from_batches(held), True)[0], id_type)
    return run


def add_vectors(spark: SparkSession, path: str, vectors: DataFrame, id_col: str = "id", embedding: str = "embedding",
                cells: int = CELLS, block_rows: int = BLOCK_ROWS) -> int:
    """R-1, S-9: write ``vectors`` as a further segment of the index at ``path`` (created, and its
    centres fitted, if there is none) and publish the next version; returns it. Earlier
    versions stay readable; a write that stops half-way is in no version."""
    known = read_manifest(spark, path)
    after, manifest = known or (0, {"dim": None, "centres": None, "segments": [], "n": 0})
    use = _usable(vectors, id_col, embedding)
    n, dim = use.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    manifest = dict(manifest, id_type=use.schema["id"].dataType.simpleString())
    if n:
        if manifest["centres"] is None:
            centres = fit_centres(use, n, dim, cells)
            manifest |= {"centres": new_folder(path, "centres"), "dim": dim}
            spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>") \
                .coalesce(1).write.parquet(manifest["centres"])
        else:
            centres, dim = _centres(spark, manifest), manifest["dim"]
        rows = max(1, min(block_rows, BLOCK_BYTES // (8 * dim)))
        id_type = manifest["id_type"]
        placed = use.mapInArrow(_assign_fn(centres), f"id {id_type}, vec array<double>, cell int, dist double, norm double")
        # a cell, even one of equal rows, is cut at any row
        order = ["cell", "dist", "id", "tie"]
        parts = int(max(1, -(-n // (64 * rows))))
        placed = (placed.withColumn("tie", F.monotonically_increasing_id())
                  .repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie"))
        folder = new_folder(path, "segment")
        placed.mapInArrow(_blocks_fn(dim, rows), f"cell int, near double, far double, norm double, n int, "
                          f"ids array<{id_type}>, vectors binary") \
            .write.option("parquet.block.size", 4 * BLOCK_BYTES).parquet(folder)
        manifest |= {"segments": [*manifest["segments"], folder], "n": manifest["n"] + n}
    return publish(spark, path, manifest, after)


def _centres(spark: SparkSession, manifest: dict[str, Any]) -> np.ndarray:
    rows = spark.read.parquet(manifest["centres"]).orderBy("cell").collect()
    return np.array([r["centre"] for r in rows], np.float64)


def load_vector_index(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
    """The last version at ``path`` or the one named; without any, FileNotFoundError."""
    known = read_manifest(spark, path, version)
    if known is None:
        raise FileNotFoundError(f"no vector index at {path}")
    at, m = known
    if not m["segments"]:
        empty = spark.createDataFrame([], f"cell int, near double, far double, norm double, n int, "
                                          f"ids array<{m['id_type']}>, vectors binary")
        return VectorIndex(empty, np.zeros((0, 0)), 0, path, at)
    return VectorIndex(spark.read.parquet(*m["segments"]), _centres(spark, m), m["n"], path, at)


def _bound(dot: np.ndarray, q_norm: np.ndarray, c_norm: np.ndarray, near, far, norm) -> np.ndarray:
    """Upper bounds of inner products, with room for rounding."""
    d = np.sqrt(np.maximum(q_norm ** 2 + c_norm ** 2 - 2 * dot, 0))
    eps = 1e-7 * (1 + q_norm + c_norm + far)        # distances by difference of squares
    gap = np.maximum(np.maximum(d - far, near - d) - eps, 0)
    best = np.minimum(dot + q_norm * far, (q_norm ** 2 + norm ** 2 - gap ** 2) / 2)
    return best + 1e-9 * (1 + q_norm * norm) + 10.0 ** -SCORE_DIGITS


def _search_fn(qids: list, qid_type: pa.DataType, qmat: np.ndarray, centres: np.ndarray, k: int, id_type: pa.DataType,
               floor: np.ndarray | None = None, home: np.ndarray | None = None):
    """Task body. ``home`` (queries, cells): score these pairs only; else those whose bound
    reaches the query's ``floor``. The last row says how much was scored."""
    q_norm, c_norm = np.linalg.norm(qmat, axis=1), np.linalg.norm(centres, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, scored, blocks = None, 0, 0
        for b in batches:
            for cell, near, far, norm, n, ids, raw in zip(*[c.to_pylist() for c in b.columns]):
                if home is not None:
                    use = np.flatnonzero(home[:, cell])
                else:
                    up = _bound(qmat @ centres[cell], q_norm, c_norm[cell], near, far, norm)
                    use = np.flatnonzero(up >= floor)
                if not len(use):
                    continue
                mat = np.frombuffer(raw, "<f8").reshape(n, -1)
                ids = np.asarray(ids)
                scored, blocks = scored + n * len(use), blocks + 1
                step = max(1, TILE_SCORES // n)
                for at in range(0, len(use), step):
                    part = use[at:at + step]
                    s = np.round(qmat[part] @ mat.T, SCORE_DIGITS)
                    least = np.partition(s, n - min(k, n), axis=1)[:, n - min(k, n)]
                    if floor is not None:
                        least = np.maximum(least, floor[part])
                    i, j = np.nonzero(s >= least[:, None])
                    best = _merge_top(best, (part[i], ids[j], s[i, j]), k)
        at, found, score = best if best is not None else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*map(int, at), None], pa.int64()), pa.array([*(qids[i] for i in at), None], qid_type),
             pa.array([*np.asarray(found).tolist(), None], id_type), pa.array([*score.tolist(), None], pa.float64()),
             pa.array([None] * m + [scored], pa.int64()), pa.array([None] * m + [blocks], pa.int64())],
            ["row", "query_id", "id", "score", "scored", "blocks"])
    return run


def search_vectors(index: VectorIndex, queries: DataFrame, k: int = DEFAULT_TOP_K, query_id: str = "query_id",
                   embedding: str = "embedding", report: bool = False):
    """(query_id, id, score, rank): the best ``k`` vectors of each query row by score rounded to
    six digits, then id. ``report`` adds a dictionary: cells and blocks read, and (query,
    vector) pairs scored, out of how many."""
    spark = index.blocks.sparkSession
    q = queries.where(F.col(query_id).isNotNull())
    q = _usable(q, query_id, embedding).withColumnRenamed("id", "query_id").distinct()
    qid, idt = q.schema["query_id"].dataType, index.blocks.schema["ids"].dataType.elementType
    schema = f"row long, query_id {qid.simpleString()}, id {idt.simpleString()}, score double, scored long, blocks long"
    seen = {"cells": 0, "cells_read": 0, "blocks_read": 0, "pairs_scored": 0, "pairs": 0}
    out = spark.createDataFrame([], f"query_id {qid.simpleString()}, id {idt.simpleString()}, score double")
    if index.n_vectors == 0:
        out = top_k(out, k)
        return (out, seen) if report else out
    cells = index.blocks.groupBy("cell").agg(
        F.min("near"), F.max("far"), F.max("norm"), F.sum("n")).collect()       # at most CENTRE_BYTES of centres
    cell, near, far, norm, size = (np.array(x) for x in zip(*sorted(map(tuple, cells))))
    n, dim = q.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    slices = max(1, -(-(n * (dim or 1) * 8) // BATCH_BYTES))
    slices = slices if slices == 1 else 2 * slices
    columns = ["cell", "near", "far", "norm", "n", "ids", "vectors"]
    for i in range(slices):
        part = q if slices == 1 else q.where(F.pmod(F.xxhash64("query_id", "vec"), F.lit(slices)) == i)
        table = part.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        qids = table.column("query_id").to_pylist()
        qmat = _matrix(table.column("vec").combine_chunks(), index.centres.shape[1])
        dots = qmat @ index.centres[cell].T
        # the nearest cells with k vectors between them give the first k-th score
        by = np.argsort(-dots, axis=1, kind="stable")
        before = np.cumsum(size[by], axis=1) - size[by]
        home = np.zeros((len(qids), len(index.centres)), bool)
        r, c = np.nonzero(before < k)
        home[r, cell[by[r, c]]] = True
        types = (to_arrow_type(qid), qmat, index.centres, k, to_arrow_type(idt))

        def run(of: np.ndarray, **how) -> DataFrame:
            blocks = index.blocks.where(F.col("cell").isin([int(x) for x in of])).select(*columns)
            return blocks.mapInArrow(_search_fn(qids, *types, **how), schema)

        first = run(np.flatnonzero(home.any(0)), home=home).where("row IS NOT NULL")
        w = Window.partitionBy("row").orderBy(F.col("score").desc())
        kth = (first.select("row", "score").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
               .groupBy("row").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect())
        floor = np.full(len(qids), -np.inf)
        for x in kth:
            floor[x["row"]] = x["s"]
        reach = np.zeros(len(cell), bool)
        step = max(1, TILE_SCORES // len(cell))
        q_norm, c_norm = np.linalg.norm(qmat, axis=1), np.linalg.norm(index.centres[cell], axis=1)
        for at in range(0, len(qids), step):
            s = slice(at, at + step)
            reach |= (_bound(dots[s], q_norm[s, None], c_norm, near, far, norm) >= floor[s, None]).any(0)
        rows = run(cell[reach], floor=floor)
        if report:
            rows = materialize(rows, "vector-search")
            done = rows.where("row IS NULL").agg(F.sum("scored"), F.sum("blocks")).first()
            seen["cells"] += len(cell)
            seen["cells_read"] += int(reach.sum())
            seen["blocks_read"] += done[1] or 0
            seen["pairs_scored"] += done[0] or 0
            seen["pairs"] += len(qids) * index.n_vectors
        out = out.unionByName(rows.where("row IS NOT NULL").select("query_id", "id", "score"))
    out = top_k(out, k)
    return (out, seen) if report else out


# Worker-side functions above travel by value (see ``ship_by_value``).
ship_by_value(__name__)
