"""Nearest vectors by cosine: a stated query set against all rows, in blocks, or by an index of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of one block (64 dimensions of 4,000 queries take 1 MB), rows met at a time: 4,000 x 2,000 similarities
#: take 32 MB.
BLOCK, ROWS = 4000, 2000


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(vectors: list) -> np.ndarray:
    m = np.array(vectors, dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _top(ids: np.ndarray, keys: np.ndarray, sims: np.ndarray, k: int, least: float) -> pd.DataFrame:
    """The k best of each row and all that are as good as the last of them, so ties are settled when all parts are in."""
    kept = sims >= max(least, -1)
    if sims.shape[1] > k:
        kept &= sims >= np.partition(sims, -k, axis=1)[:, -k][:, None] - 1e-9
    i, j = np.nonzero(kept)
    return pd.DataFrame({"query": ids[i], "k": keys[j], "similarity": sims[i, j]})


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, year: str | None = None, k: int = 10, least: float = 0.0, span: int = 2, year_required: bool = False) -> DataFrame:
    """V2-V5: (query, key, similarity, rank) of the k nearest rows other than the query, not below ``least``.

    Years more than ``span`` apart are passed over; missing ones are not, unless ``year_required`` and the query has one.  Each block of queries meets every row once, as
    one matrix product per batch that keeps k rows a query; only those are shuffled.
    """
    columns = [key, vector] + ([year] if year else [])
    n = queries.count()
    out = None
    blocks = max(1, -(-n // BLOCK))
    for part in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == part).select(*columns).orderBy(key).collect()
        ids = np.array([r[key] for r in block])
        if not len(ids):
            continue
        q = _unit([r[vector] for r in block])
        years = np.array([np.nan if not year or r[year] is None else r[year] for r in block], dtype=float)
        held = queries.sparkSession.sparkContext.broadcast((ids, q, years))

        def score(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q, years = held.value
            for part in parts:
                for at in range(0, len(part), ROWS):
                    p = part.iloc[at : at + ROWS]
                    p = p[p[vector].notna()]
                    if not len(p):
                        continue
                    sims, keys = q @ _unit(p[vector].tolist()).T, p[key].to_numpy()
                    sims[ids[:, None] == keys[None, :]] = -2
                    if year:
                        gap = np.abs(years[:, None] - p[year].to_numpy(dtype=float)[None, :])
                        sims[gap > span] = -2
                        if year_required:
                            sims[np.isnan(gap) & ~np.isnan(years)[:, None]] = -2
                    found = _top(ids, keys, sims, k, least)
                    if len(found):
                        yield found.set_axis(["query", key, "similarity"], axis=1)

        kind = rows.schema[key].dataType.simpleString()
        found = rows.select(*columns).mapInPandas(score, f"query {kind}, {key} {kind}, similarity double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fit_cells(rows: DataFrame, key: str, vector: str, cells: int, sample: int = 20_000, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """V6: centres of cells, by spherical k-means over a sample of ``sample`` rows at most, taken by a digest of the key."""
    from refloom.operators.sampling import order_key

    held = rows.filter(F.col(vector).isNotNull()).select(key, vector).orderBy(order_key(F.col(key), seed), key).limit(sample).collect()
    m = _unit([r[vector] for r in held])
    centres = m[np.random.default_rng(seed).choice(len(m), size=min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        of = (m @ centres.T).argmax(axis=1)
        centres = np.array([m[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def with_cells(rows: DataFrame, vector: str, centres: np.ndarray, n: int = 1) -> DataFrame:
    """Adds ``cells``: the n nearest cells of every row, the nearest first; rows without a vector have none."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def assign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            there = s.notna().to_numpy()
            out = np.empty(len(s), dtype=object)
            if there.any():
                best = np.argsort(-(_unit(s[there].tolist()) @ held.value.T), axis=1, kind="stable")[:, :n]
                for i, x in zip(np.flatnonzero(there), best):
                    out[i] = x.tolist()
            yield pd.Series(out)

    return rows.withColumn("cells", assign(F.col(vector)))


def nearest_in_cells(queries: DataFrame, rows: DataFrame, key: str, vector: str, centres: np.ndarray, k: int = 10, probes: int = 8) -> DataFrame:
    """V6: (query, key, similarity, rank) among the rows of the query's ``probes`` nearest cells.

    Every row is indexed.  Rows and queries meet by an equal cell; a hot cell is split by the engine's skew join.
    """
    q = with_cells(queries.select(F.col(key).alias("query"), F.col(vector).alias("a")), "a", centres, probes).select("query", "a", F.explode("cells").alias("cell"))
    r = with_cells(rows.select(key, F.col(vector).alias("b")), "b", centres).select(key, "b", F.explode("cells").alias("cell"))
    met = q.join(r, "cell").filter(F.col("query") != F.col(key)).select("query", key, cosine(F.col("a"), F.col("b")).alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), key)
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
