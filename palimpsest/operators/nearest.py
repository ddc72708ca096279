"""Exact nearest vectors by dot product, block against block.

Vectors and queries are dealt into a grid of cells. A matrix product, in single precision
if all are floats and with a bound on its error, leaves out pairs that can't be among a
query's best k of its cell: first groups of vectors by their best product, then vectors.
Products of the others are added in the order of the elements, as SQL does, so that
scores and ties are the same to the last bit. Pairs never become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import fusion

#: Most rows of a cell, which a task holds at once.
VECTORS, QUERIES = 32768, 8192
#: Most scores that leave a cell.
FOUND = 1 << 22
#: Fewest vectors of a cell, if it is cut for more tasks; most queries compared and pairs scored at a time.
_V, _Q, _PAIRS = 2048, 256, 4096
#: Most products compared at a time, and vectors of a group, of which the best is compared first.
_NEAR, _GROUP = 1 << 20, 16


def by_dot(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank): top k of each query; a score that can't be had is null and ranks last."""
    spark = vectors.sparkSession
    v, q = vectors.select("doc_id", "embedding"), queries.select("qid", "embedding")
    n, m = v.select(F.lit(1).alias("v"), F.lit(0).alias("q")).union(q.select(F.lit(0), F.lit(1))).agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in "vq")).first()
    tasks, found = 3 * spark.sparkContext.defaultParallelism, max(1, min(k, n))
    # The more cells lie across, the more copies of vectors, the fewer scores: a vector is taken to be as long as eight scores.
    across = max(1, -(-m // max(1, min(QUERIES, FOUND // found))), min(-(-m // _Q), round((tasks * m * found / max(1, 8 * n)) ** 0.5)))
    down = max(1, -(-n // VECTORS), min(-(-n // _V), -(-tasks // across)))
    # A row's place on its side of the grid is a hash; copies of it go to all cells of its line there.
    v = _dealt(v, down, across, F.col("place") * across + F.col("copy"))
    q = _dealt(q, across, down, F.col("copy") * across + F.col("place"))
    kinds = {f.name: f.dataType for d in (v, q) for f in d.schema}
    schema = T.StructType([T.StructField("qid", kinds["qid"]), T.StructField("doc_id", kinds["doc_id"]), T.StructField("score", T.DoubleType())])
    cells = down * across
    sides = v.repartition(cells, "cell").groupBy("cell").cogroup(q.repartition(cells, "cell").groupBy("cell"))
    return fusion.ranked(sides.applyInArrow(lambda a, b: best_of_cell(a, b, k), schema), k)


def _dealt(rows: DataFrame, places: int, copies: int, cell: Column) -> DataFrame:
    """rows, each in as many cells as there are copies."""
    placed = rows.select("*", F.pmod(F.xxhash64(*rows.columns), F.lit(places)).alias("place"))
    return placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")).select(cell.alias("cell"), *rows.columns)


def best_of_cell(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(qid, doc_id, score): the best k of each query among these vectors."""
    vectors = vectors.take(pc.sort_indices(vectors, [("doc_id", "ascending")], null_placement="at_end"))
    (v_len, v_flat, v_from), (q_len, q_flat, q_from) = _elements(vectors["embedding"]), _elements(queries["embedding"])
    found = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0), np.zeros(0, bool))]  # row of queries, row of vectors, score, whether it is null
    for size in np.unique(q_len):
        qs = np.flatnonzero(q_len == size)
        vs = np.flatnonzero(v_len == size) if size >= 0 else np.arange(0)
        if len(vs):
            a, b = _matrix(v_flat, v_from[vs], size), _matrix(q_flat, q_from[qs], size)
            r, p, s = _best(a, b, k)
            found.append((qs[r], vs[p], s, np.zeros(len(r), bool)))
        # Without enough vectors of its length, a query gets others, in order of their ids.
        rest = np.flatnonzero((v_len != size) | (v_len < 0))[: max(0, k - len(vs))]
        none = len(qs) * len(rest)
        found.append((np.repeat(qs, len(rest)), np.tile(rest, len(qs)), np.zeros(none), np.ones(none, bool)))
    rows, docs, scores, null = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"qid": queries["qid"].take(pa.array(rows)), "doc_id": vectors["doc_id"].take(pa.array(docs)), "score": pa.array(scores, mask=null, from_pandas=False)})


def _matrix(flat: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    if len(flat) == len(begin) * size:
        return flat.reshape(len(begin), size)
    return flat[begin[:, None] + np.arange(size)]


def _elements(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of vectors: lengths, -1 for a vector that is or has a null; all elements; where each vector begins."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")
    begin = np.cumsum(size) - size
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    bad = lists.is_null().to_numpy(zero_copy_only=False) | (holes[begin + size] > holes[begin])
    return np.where(bad, -1, size), flat.fill_null(0).to_numpy(zero_copy_only=False), begin


def _best(a: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of a, score) of the best k rows of a for each of q; NaN is the greatest, ties by row of a."""
    (n, size), single = a.shape, a.dtype == q.dtype == np.float32
    a, q = (a, q) if single else (a.astype("float64"), q.astype("float64"))
    # Products of single precision must neither overflow nor lose more than this below the normal numbers.
    unit, tiny, most = (2.0**-23, (size + 4) * 2.0**-125, 1e37) if single else (2.0**-51, 1e-300, np.inf)
    found = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
    with np.errstate(all="ignore"):
        v_norm, q_norm = _norms(a), _norms(q)
        # Vectors of like length make a group, a column of order. The first may have places to fill up, which are -1.
        group = max(1, min(_GROUP, n // (4 * k)))
        fill, groups = -n % group, -(-n // group)
        order = np.concatenate([np.full(fill, -1), np.argsort(v_norm, kind="stable")]).reshape(groups, group).T
        rows, longest = a[order.ravel()], v_norm[order[-1]]
        step = max(1, min(_Q, _NEAR // n))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            near = (part @ rows.T).reshape(len(part), group, groups)
            near[:, :fill, 0] = -np.inf
            best = near.max(axis=1).astype("float64")
            # A matrix product adds in another order, and may be of single precision; this is more than it can differ by.
            length = q_norm[lo : lo + step, None] * longest
            off = (size + 4) * unit * length + tiny
            sure = np.isfinite(best) & np.isfinite(off) & (length < most)
            # k groups have a score of at least the bound. What isn't a number here is taken.
            bound = np.partition(np.where(sure, best - off, -np.inf), groups - k, axis=1)[:, groups - k] if groups >= k else np.full(len(part), -np.inf)
            i, g = np.nonzero(~sure | (best + off >= bound[:, None]))
            x, y = np.nonzero(~sure[i, g][:, None] | (near[i, :, g] + off[i, g][:, None] >= bound[i][:, None]))
            i, j = i[x], order[y, g[x]]
            i, j = i[j >= 0], j[j >= 0]
            exact = _scores(part, a, i, j)
            by = np.lexsort((j, -exact, ~np.isnan(exact), i))
            by = by[np.arange(len(by)) - np.searchsorted(i[by], i[by]) < k]
            found.append((lo + i[by], j[by], exact[by]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows, scaled by the greatest element, so that small ones don't vanish."""
    top = np.abs(rows).max(axis=1, initial=0).astype("float64")
    return np.where(top == 0, 0, top * np.sqrt(((rows / top[:, None]) ** 2).sum(axis=1)))


def _scores(q: np.ndarray, a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of q and j of a, added in the order of the elements."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), _PAIRS):
        at = slice(lo, lo + _PAIRS)
        for x in (q[i[at]].astype("float64") * a[j[at]]).T:
            out[at] += x
    return out
