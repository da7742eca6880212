"""Texts packed into containers of a fixed number of tokens by multiway differencing.

Sizes come from a public tokenizer.  Items are spread over shards of a bounded number of windows; in a shard the
Karmarkar-Karp method merges the two partial partitions of the largest differences, the full windows of one on the empty
ones of the other, until one near-equal partition is left.  What stands over the capacity is exchanged for differences
other windows have room for; for items that find no room the number of windows rises.

Defined results
* null text: no item.  Empty text: an item of no tokens, in a container like any other.
* an item over the capacity is cut into full containers and a rest; only such items are cut (``piece_ix`` > 0 exists).
* equal sizes, repeated texts: every row is its own item; the key has to be unique.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redloom.session import staged

TOKENIZERS = os.environ.get("REDLOOM_TOKENIZERS", "/opt/tokenizers")
#: How the byte-level tokenizer cuts text before merging; part of that public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Windows of one shard; waste from rounding up is below one window in so many.
WINDOWS = 128


def load_encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(key, n_tokens) of every text that is not null; ``tokenizer`` is a ``.tiktoken`` file every executor can read."""
    path = tokenizer or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or load_encoder(path)
            sizes = [len(encoder.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["key", "n_tokens"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, "key long, n_tokens long")


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """A partition of the sizes' indices into ``k`` windows of near-equal sums."""
    n = len(sizes)
    # nodes 0..n-1 are items, later ones two nodes that share a window; there are at most n - 1 of those
    left, right = np.full(2 * n + 1, -1), np.full(2 * n + 1, -1)
    heap: list = [(-int(sizes[i]), i, sizes[i : i + 1].astype(np.int64), np.array([i])) for i in range(n)]
    heapq.heapify(heap)
    made, node = n, n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        a, b = len(sa), len(sb)
        if a + b <= k:  # windows to spare: nothing has to share one
            sums, nodes = np.concatenate([sa, sb]), np.concatenate([na, nb])
        else:
            # the largest of one on the smallest of the other: only the last ``both`` of each share
            both = a + b - k
            sums, nodes = np.empty(k, np.int64), np.empty(k, np.int64)
            sums[: a - both], nodes[: a - both] = sa[: a - both], na[: a - both]
            sums[a:], nodes[a:] = sb[: b - both], nb[: b - both]
            x, y = na[a - both :], nb[b - both :][::-1]
            left[node : node + both], right[node : node + both] = x, y
            sums[a - both : a], nodes[a - both : a] = sa[a - both :] + sb[b - both :][::-1], np.arange(node, node + both)
            node += both
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = sums[-1] if len(sums) == k else 0
        made += 1
        heapq.heappush(heap, (-int(sums[0] - low), made, sums, nodes))
    windows = []
    for root in heap[0][3].tolist() if heap else []:
        items, stack = [], [root]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += [int(left[x]), int(right[x])]
        windows.append(items)
    return windows


def _exchange(windows: list[list[int]], sizes: np.ndarray, capacity: int) -> list[int]:
    """Bring windows over the capacity down by exchanging differences; the items no window has room for.

    An item of such a window changes places with a smaller one (or none) of a window that has room for the difference:
    the least difference that is enough, else the greatest there is room for.  Where there is none, the window gives up
    the least item that is enough.
    """
    n = len(sizes)
    at = np.empty(n, np.int64)
    for i, w in enumerate(windows):
        at[w] = i
    sums = np.bincount(at, sizes, len(windows)).astype(np.int64)
    for i in np.argsort(-sums, kind="stable").tolist():
        while sums[i] > capacity:
            over = sums[i] - capacity
            # partners: every item of another window, and no item of each
            part = np.concatenate([np.where(at < 0, i, at), np.arange(len(windows))])
            size = np.concatenate([sizes, np.zeros(len(windows), np.int64)])
            room = np.where(part == i, -1, capacity - sums[part])
            best = None
            for x in np.flatnonzero(at == i).tolist():
                delta = int(sizes[x]) - size
                fits = np.flatnonzero((delta > 0) & (delta <= room))
                if not len(fits):
                    continue
                enough = fits[delta[fits] >= over]
                y = int(enough[delta[enough].argmin()]) if len(enough) else int(fits[delta[fits].argmax()])
                rank = (delta[y] >= over, -delta[y] if delta[y] >= over else delta[y])
                if best is None or rank > best[0]:
                    best = (rank, x, y, int(delta[y]))
            if best is None:
                own = np.flatnonzero(at == i)
                enough = own[sizes[own] >= over]
                x = int(enough[sizes[enough].argmin()] if len(enough) else own[sizes[own].argmax()])
                at[x] = -1
                sums[i] -= sizes[x]
                continue
            _, x, y, d = best
            j = int(part[y])
            at[x] = j
            if y < n:
                at[y] = i
            sums[i] -= d
            sums[j] += d
    loose = []
    for x in sorted(np.flatnonzero(at < 0).tolist(), key=lambda x: -sizes[x]):
        room = capacity - sums
        fit = np.where(room >= sizes[x], room, np.iinfo(np.int64).max)
        j = int(fit.argmin())
        if room[j] < sizes[x]:
            loose.append(x)
            continue
        at[x] = j
        sums[j] += sizes[x]
    for w in windows:
        w.clear()
    for x, i in enumerate(at.tolist()):
        if i >= 0:
            windows[i].append(x)
    return loose


def fill_windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; ``sizes`` are at most that.

    Differencing starts with the fewest windows there can be; what stands over the capacity is exchanged for differences
    that other windows have room for.  For items that find no room the number of windows rises: they are differenced into
    further windows.
    """
    out: list[list[int]] = []
    rest = np.arange(len(sizes))
    while len(rest):
        own = sizes[rest]
        windows = difference(own, max(1, -(-int(own.sum()) // capacity)))
        loose = _exchange(windows, own, capacity)
        out += [rest[w].tolist() for w in windows if w]
        rest = rest[loose]
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes, cap = pdf["n_tokens"].to_numpy(np.int64), int(pdf["max_tokens"].iloc[0])
    at = np.empty(len(pdf), np.int64)
    full = np.flatnonzero(sizes == cap)
    at[full] = np.arange(len(full))
    rest = np.flatnonzero(sizes < cap)
    for i, w in enumerate(fill_windows(sizes[rest], cap)):
        at[rest[w]] = len(full) + i
    out = pdf.drop(columns=["max_tokens"])
    out["window"] = at
    return out


def pack(sizes: DataFrame, capacities: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """(capacity_id, container_id, key, piece_ix, start_token, n_tokens) of ``sizes(key, n_tokens)`` for each row of the small table ``capacities(capacity_id, max_tokens)``."""
    caps = capacities.where("max_tokens > 0").select("capacity_id", F.col("max_tokens").cast("long").alias("max_tokens"))
    # one row a capacity: the number of shards
    shards = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("items")).crossJoin(F.broadcast(caps))
    shards = shards.select("capacity_id", "max_tokens", F.greatest(F.lit(1), F.ceil(F.col("total") / (F.col("max_tokens") * windows)), F.ceil(F.col("items") / (windows * 64))).alias("n_shards"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("max_tokens")) - 1)
    pieces = sizes.join(F.broadcast(shards)).select("key", "capacity_id", "max_tokens", "n_shards", F.col("n_tokens").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("capacity_id", "max_tokens", "key", F.col("piece").cast("int").alias("piece_ix"), (F.col("piece") * F.col("max_tokens")).alias("start_token"), F.least("max_tokens", F.col("whole") - F.col("piece") * F.col("max_tokens")).alias("n_tokens"), F.pmod(F.xxhash64("key", "piece"), F.col("n_shards")).alias("shard"))
    kind = dict(capacities.dtypes)["capacity_id"]
    packed = pieces.groupBy("capacity_id", "shard").applyInPandas(_pack, f"capacity_id {kind}, key long, piece_ix int, start_token long, n_tokens long, shard long, window long")
    return packed.select("capacity_id", F.concat_ws("-", "capacity_id", "shard", "window").alias("container_id"), "key", "piece_ix", "start_token", "n_tokens")


def pack_texts(df: DataFrame, key: str, text: str, capacities: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(staged(token_sizes(df, key, text, tokenizer), "token-sizes"), capacities)
