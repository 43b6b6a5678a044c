"""Filling fixed-capacity containers: hierarchical residual packing.

Each group of items is packed best-fit decreasing and emits the nearly full bins; the underfull bins of several groups then
meet as items of one task of the next round, and so on up a tree, until one task held them all. Only sizes and bins are
moved, not what is in the bins; at the end each item follows its bin."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.runtime import spread, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the byte-level vocabulary above.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[tuple[str, str], object] = {}


def tokenizer(path: str = TOKENIZER, pattern: str = PATTERN):
    """The tokenizer of a rank file, loaded once in each worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def token_counts(docs: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """key, n_tokens of each row; null and empty texts have 0 tokens. Texts of any length are encoded as a whole."""

    def count(batches):
        enc = tokenizer(path)
        for b in batches:
            n = [count_tokens(enc, t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    return spread(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))).mapInArrow(count, f"key {dict(docs.dtypes)[key]}, n_tokens long")


#: Runs of white space (Unicode's) that the pattern's matcher has no stack for.
_LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def count_tokens(enc, text: str) -> int:
    """Number of tokens. By the pattern, a run of white space but for its last sign, or all of it at the end of the text, is one
    piece; long runs are handed over as such."""
    n, start = 0, 0
    if len(text) >= 1000:
        for m in _LONG_BLANK.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            n += len(enc.encode_ordinary(text[start : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
            start = end
    return n + len(enc.encode_ordinary(text[start:]))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: largest first, each into the bin it leaves the least room in, else into a new one."""
    out = np.empty(len(sizes), dtype=np.int64)
    rooms: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, n
            n += 1
        out[i] = b
        if room > size:
            insort(rooms, (room - size, b))
        elif size == 0:
            insort(rooms, (0, b))
    return out


@dataclass(frozen=True)
class Packing:
    """containers: the rows of ``pack``. rounds: for each round its number of groups (tasks), and of underfull bins before and
    of all bins after it."""

    containers: DataFrame
    rounds: list[tuple[int, int, int]]


def pack(items: DataFrame, key: str, size: str, capacity: int, **settings) -> DataFrame:
    """container, fill, piece's key, piece_no, from_token, n_tokens: see ``packed``."""
    return packed(items, key, size, capacity, **settings).containers


def packed(items: DataFrame, key: str, size: str, capacity: int, full: float = 0.99, task_items: int = 50_000, least_groups: int = 16, fan: int = 4, task_bins: int = 50_000, least_gain: float = 0.005) -> Packing:
    """Each item in exactly one container, or in pieces if it is larger than the capacity.

    Items above the capacity give full pieces that are containers of their own and one smaller piece that is packed like any
    item. Items are grouped by hash, ``task_items`` to a group but at least ``least_groups`` groups, and packed in their
    group. Bins that are at least ``full`` full are final at once; the underfull ones meet in ``fan`` times fewer groups, and
    so on until one group held them all. No more than about ``task_bins`` bins meet in a task: where there are more, rounds
    end once one of as few groups as that allows saved less than ``least_gain`` of the bins.
    The result depends on the rows alone, not on how they are partitioned; of equal rows any may be in either place. Items
    of null or negative size count as empty; items without tokens are packed too (they need no room). Repeated keys are
    items of their own. No rows give no containers. ValueError for a capacity below 1."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    kind = dict(items.dtypes)[key]
    sized = items.select(F.col(f"`{key}`").alias("key"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    # Equal rows are counted where they are and told apart by number, so that copies are spread over the groups.
    block = 100_000
    copies = sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    single = copies.select("key", "size", F.explode(F.sequence("from", F.least(F.col("from") + block, F.col("n")) - 1)).alias("copy"))
    single = stored(single.select("key", "size", F.xxhash64("key", "size", "copy").alias("hash")), "items")
    groups = max(least_groups, -(-single.count() // task_items))

    def local(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.lexsort((part["hash"].to_numpy(), -part["size"].to_numpy()))))
        sizes = part["size"].to_numpy()
        whole = sizes // capacity
        rest = sizes - whole * capacity
        small = np.flatnonzero((whole == 0) | (rest > 0))
        bins = best_fit_decreasing(rest[small], capacity)
        cut = np.repeat(np.arange(len(sizes)), whole)
        piece = np.arange(len(cut)) - np.repeat(np.cumsum(whole) - whole, whole)
        fill = np.bincount(bins, weights=rest[small]).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
        row = np.concatenate([cut, small])
        number = np.concatenate([np.arange(len(cut)), len(cut) + bins])
        n_tokens = np.concatenate([np.full(len(cut), capacity), rest[small]])
        piece_no = np.concatenate([piece, whole[small]])
        lead = np.zeros(len(row), dtype=bool)
        lead[np.unique(number, return_index=True)[1]] = True
        first = int(part["g"][0].as_py()) << 32
        return pa.table(
            [part["key"].take(pa.array(row)), pa.array(piece_no.astype(np.int32)), pa.array(piece_no * capacity), pa.array(n_tokens), pa.array(number + first), pa.array(np.concatenate([np.full(len(cut), capacity), fill[bins]])), pa.array(lead)],
            names=["key", "piece_no", "from_token", "n_tokens", "bin", "fill", "lead"],
        )

    hashed = single.withColumn("g", F.pmod("hash", F.lit(groups)))
    placed = stored(hashed.groupBy("g").applyInArrow(local, f"key {kind}, piece_no int, from_token long, n_tokens long, bin long, fill long, lead boolean"), "bins")
    under = placed.where("lead").where(F.col("fill") < full * capacity).select("bin", F.col("bin").alias("root"), "fill")
    n_under = under.count()
    rounds = [(groups, single.count(), placed.where("lead").count())]
    final: list[DataFrame] = []
    while groups > 1 and n_under > 1:
        least = -(-n_under // task_bins)
        last = groups <= least * fan
        groups = max(least, -(-groups // fan))
        merged = stored(under.withColumn("g", F.pmod(F.xxhash64("root"), F.lit(groups))).groupBy("g").applyInArrow(lambda t: _merge_bins(t, capacity), "bin long, root long, fill long"), "merged")
        n = merged.select("root").distinct().count()
        rounds.append((groups, n_under, n))
        if groups == 1 or (last and n > n_under * (1 - least_gain)):
            final.append(merged)
            break
        final.append(merged.where(F.col("fill") >= full * capacity))
        under = merged.where(F.col("fill") < full * capacity)
        n_under = under.select("root").distinct().count()
        if n_under <= 1:
            final.append(under)
    if not final:
        return Packing(placed.select(F.col("bin").alias("container"), "fill", F.col("key").alias(key), "piece_no", "from_token", "n_tokens"), rounds)
    moved = reduce(DataFrame.unionByName, final).select("bin", "root", F.col("fill").alias("whole"))
    return Packing(placed.join(moved, "bin", "left").select(F.coalesce("root", "bin").alias("container"), F.coalesce("whole", "fill").alias("fill"), F.col("key").alias(key), "piece_no", "from_token", "n_tokens"), rounds)


def _merge_bins(part: pa.Table, capacity: int) -> pa.Table:
    """Packs bins as items; those that share a new bin get the name of the first of them."""
    root, fill = part["root"].to_numpy(), part["fill"].to_numpy()
    names, first, of = np.unique(root, return_index=True, return_inverse=True)
    order = np.lexsort((names, -fill[first]))
    sizes = fill[first][order]
    new = np.empty(len(names), dtype=np.int64)
    new[order] = best_fit_decreasing(sizes, capacity)
    total = np.bincount(new, weights=fill[first]).astype(np.int64)
    least = np.full(len(total), np.iinfo(np.int64).max)
    np.minimum.at(least, new, names)
    return pa.table([part["bin"], pa.array(least[new][of]), pa.array(total[new][of])], names=["bin", "root", "fill"])
