"""Items of varying length in containers of fixed capacity, with little space unused.

Hierarchical residual packing: every partition packs its items by best fit, longest first.  Containers that are nearly
full leave; the others become items themselves, keep what they hold and are packed again with those of other partitions,
in ever fewer partitions, until the rest fits one task or no round brings fewer.  What a container holds is bounded by its
capacity, and a task never gets more than ``TASK`` of them, so nothing unbounded gathers anywhere.

Defined results: an item longer than the capacity is cut into pieces of the capacity and a rest; null and empty texts
have no tokens, fit anywhere and are dealt out over the containers in turn; capacities that are null or not positive hold nothing; an id
that comes twice is two items.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts text into words before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Items of one task, at most about; share of the capacity that a container may leave unused to count as full.
TASK, SLACK = 40_000, 0.005
#: Capacities that one pass over the items takes; more take more passes.
MOST_PACKS = 100
MEMBERS = "array<struct<id:bigint,piece:int,tokens:int>>"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("refloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds the number of tokens of ``text``; 0 for null."""

    @F.pandas_udf(T.IntegerType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(tokenizer)
        for s in parts:
            yield s.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int32")

    return df.withColumn(out, count(F.col(f"`{text}`")))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items of each container: longest first, each where least space is left over."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: (-sizes[i], i)):
        k = bisect_left(free, (sizes[i], -1))
        if k < len(free):
            left, b = free.pop(k)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(free, (left - sizes[i], b))
    # What has no size would all go into the fullest container; dealt out, no container holds more than its share.
    empty = [i for i in range(len(sizes)) if not sizes[i]]
    bins = bins or [[] for _ in range(-(-len(empty) // capacity))]
    for n, i in enumerate(empty):
        bins[n % len(bins)].append(i)
    return bins


def _round(number: int, last: bool):
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        held = [p for p in parts if len(p)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True).sort_values(["pack_id", "order"], kind="stable")
        for pack_id, group in rows.groupby("pack_id", sort=True):
            capacity = int(group["capacity"].iloc[0])
            sizes, members = group["size"].tolist(), group["members"].tolist()
            out = []
            for k, chosen in enumerate(best_fit(sizes, capacity)):
                size = sum(sizes[i] for i in chosen)
                full = last or capacity - size <= SLACK * capacity
                out.append((pack_id, capacity, size, f"{pack_id}-{number}-{task}-{k}", full, [dict(m) for i in chosen for m in members[i]]))
            yield pd.DataFrame(out, columns=["pack_id", "capacity", "size", "container", "full", "members"])

    return pack


def pack(items: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, id, piece, tokens, container) for items (id, tokens) and packs (pack_id, capacity)."""
    # Capacities are parameters, few as they are; each is a packing of its own.
    fit = packs.select("pack_id", F.col("capacity").cast("int").alias("capacity")).filter("pack_id IS NOT NULL AND capacity > 0").distinct().orderBy("pack_id", "capacity").collect()
    kind = "array<struct<pack_id:int,capacity:int>>"
    rows = None
    for at in range(0, max(1, len(fit)), MOST_PACKS):
        kinds = F.array(*[F.struct(F.lit(r["pack_id"]).alias("pack_id"), F.lit(r["capacity"]).alias("capacity")) for r in fit[at : at + MOST_PACKS]]).cast(kind)
        part = items.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("tokens").cast("int"), F.lit(0)).alias("tokens"), F.explode(kinds).alias("k")).select("id", "tokens", "k.pack_id", "k.capacity")
        rows = part if rows is None else rows.unionByName(part)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))
    rows = rows.select("pack_id", "capacity", "id", "tokens", F.explode(F.sequence(F.lit(1), pieces)).alias("piece"))
    size = F.greatest(F.lit(0), F.least(F.col("capacity"), F.col("tokens") - (F.col("piece") - 1) * F.col("capacity"))).cast("int")
    rows = rows.withColumn("size", size).select("pack_id", "capacity", "size", F.array(F.struct("id", "piece", F.col("size").alias("tokens"))).cast(MEMBERS).alias("members"), F.xxhash64("pack_id", "id", "piece").alias("order"))
    schema = f"pack_id int, capacity int, size int, container string, full boolean, members {MEMBERS}"
    open_ = cut(rows)
    done, number, before = [], 0, None
    while True:
        n = open_.count()
        parts = max(1, -(-n // TASK))
        # One task packs the rest; or a round that made nothing smaller shows that the rest can't be packed closer.
        last = parts == 1 or (before is not None and n > 0.9 * before)
        packed = cut(open_.repartition(parts, "order").mapInPandas(_round(number, last), schema))
        done.append(packed.filter("full"))
        if last:
            break
        before, number = n, number + 1
        open_ = packed.filter("NOT full").select("pack_id", "capacity", "size", "members", F.xxhash64("container").alias("order"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("pack_id", "container", F.explode("members").alias("m")).select("pack_id", "m.id", "m.piece", "m.tokens", "container")
