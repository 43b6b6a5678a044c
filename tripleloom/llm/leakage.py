"""Evaluation texts leaking into training text: greedy string tiling.

Documents are read as words (see tex); runs of ``seed`` words are seeds, and those that a document and an item share are found
by joining Karp-Rabin fingerprints. Shared seeds that follow each other in both make up the longest matches; of these the
longest of unmarked words is marked again and again. Tiles may come in any order, so reordered passages count."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm import tex
from tripleloom.runtime import spread, stored

_BASE = 1_000_003
#: Bits of the filter that documents are read with: so many for each seed, within these bounds (at most 64 MB are broadcast).
FILTER_BITS = (20, 29)
BITS_A_SEED = 32
#: Shared seeds that a task takes at a time: those of many documents and items, each pair's together.
BUCKET_SEEDS = 50_000
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 2_000_000


class _Hashes(dict):
    """Words and their 64-bit hashes, the same in every worker; each is made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = _Hashes()


def fingerprints(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin fingerprints modulo 2^64 of all runs of k numbers, with their bits mixed."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(_BASE) + ids[i : i + n]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_ids(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def diagonals(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in the document, place in the item) from the places of equal seeds: neighbours on a
    diagonal are one match, as equal runs of ``seed`` words that follow each other are one longer run."""
    shift = doc - item
    order = np.lexsort((doc, shift))
    d, s = doc[order], shift[order]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    d, s = d[keep], s[keep]
    first = np.ones(len(d), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1] + 1)
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(d))) + seed - 1
    return list(zip(n.tolist(), d[starts].tolist(), (d[starts] - s[starts]).tolist()))


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest match whose words are all unmarked becomes a tile, until none of ``least`` words is
    left; a match that is partly marked goes on with its unmarked runs. Of equal lengths the first place goes first."""
    heap = [(-n, p, i) for n, p, i in matches]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while heap:
        n, p, i = heapq.heappop(heap)
        n, start = -n, None
        free = [p + j not in in_doc and i + j not in in_item for j in range(n)]
        if all(free):
            out.append((n, p, i))
            in_doc.update(range(p, p + n))
            in_item.update(range(i, i + n))
            continue
        for j, f in enumerate([*free, False]):
            if f and start is None:
                start = j
            elif not f and start is not None:
                if j - start >= least:
                    heapq.heappush(heap, (-(j - start), p + start, i + start))
                start = None
    return out


def readings(text: str) -> Iterator[list[str]]:
    """Word streams of a document: what is visible, what is commented out, and with it everything in its place."""
    own = tex.macros(text)
    seen = tex.visible(text)
    yield tex.words(tex.plain(tex.without_definitions(seen) if own else seen, own))
    if "%" in text or "\\iffalse" in text:
        out = tex.hidden(text)
        if out.strip():
            yield tex.words(tex.plain(out, own))
        yield mixed(text)


def mixed(text: str) -> list[str]:
    """All words in their places, commented out or not."""
    return tex.words(tex.plain(tex.everything(text), tex.macros(text)))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = 6, least: int = 6) -> DataFrame:
    """doc_id, item_id, longest (words of the longest tile), covered (words of the item in tiles of at least ``least`` words),
    n_words (of the item), coverage: one row for each document and item that share a tile; the best of the document's
    readings counts.

    Documents are read once. What leaves the reading are the fingerprints of those runs of ``seed`` words that a filter
    of the items' seeds lets through (bits of a bounded number, broadcast); they are joined with the items' seeds, and tiles are
    made of the equal seeds of a document and an item. Equal fingerprints (64 bits) are taken for equal words. ``least``
    is at least ``seed``, else ValueError.
    Null and empty texts share nothing; null ids are kept as ids. Rows with the same id and text count as one, both of
    documents and of items; rows with the same id and other texts have a row each. Other columns are ignored."""
    if least < seed:
        raise ValueError("tiles are no shorter than seeds")
    kind_d, kind_i = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    seeds = stored(item_seeds(items, item_id, item_text, seed), "seeds")
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))
    rows = spread(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("doc_text"), F.col(f"`{text}`").alias("text"))).where(F.length("text") > 0)
    hits = rows.mapInArrow(_reader(bits, seed), f"doc_id {kind_d}, doc_text long, reading int, doc_place int, fingerprint long")
    pair = F.xxhash64(*(x for c in ("doc_id", "item_id") for x in (F.col(c).isNull(), F.col(c))), "doc_text", "item_text").alias("pair")
    same = stored(hits.join(seeds, "fingerprint").select("doc_id", "item_id", "n_words", "reading", "doc_place", "item_place", pair), "same")
    buckets = max(1, -(-same.count() // BUCKET_SEEDS))
    bucketed = same.withColumn("bucket", F.pmod("pair", F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInArrow(_tiler(seed, least), f"doc_id {kind_d}, item_id {kind_i}, longest int, covered int, n_words int, coverage double")


def item_seeds(items: DataFrame, item_id: str, item_text: str, seed: int) -> DataFrame:
    """fingerprint, item_place, item_id, item_text (hash), n_words: the seeds of each distinct item."""
    kind = dict(items.dtypes)[item_id]
    once = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where(F.length("text") > 0).distinct()

    def read(batches):
        for b in batches:
            words = [word_ids(tex.words(tex.plain(t, {}))) for t in b.column("text").to_pylist()]
            prints = [fingerprints(w, seed) for w in words]
            n = np.array([len(p) for p in prints], dtype=np.int64)
            row = np.repeat(np.arange(b.num_rows), n)
            if not len(row):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(prints).view(np.int64)), pa.array(np.concatenate([np.arange(x) for x in n]).astype(np.int32)), b.column("item_id").take(pa.array(row)), b.column("item_text").take(pa.array(row)), pa.array(np.array([len(w) for w in words], dtype=np.int32)[row])],
                names=["fingerprint", "item_place", "item_id", "item_text", "n_words"],
            )

    return once.withColumn("item_text", F.xxhash64("text")).mapInArrow(read, f"fingerprint long, item_place int, item_id {kind}, item_text long, n_words int")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bits that are set at the top bits of each fingerprint. Pages of bits are made where the seeds are, so the driver
    gets the bits only; their number is bounded, more seeds only let more through."""
    low, high = FILTER_BITS
    width = min(high, max(low, int(seeds.count() * BITS_A_SEED).bit_length()))
    page = 16

    def paint(part: pa.Table) -> pa.Table:
        own = np.zeros(1 << page, dtype=bool)
        own[part["slot"].to_numpy() & ((1 << page) - 1)] = True
        return pa.table([part["page"][:1], pa.array([np.packbits(own).tobytes()], pa.binary())], names=["page", "bits"])

    slot = F.shiftrightunsigned("fingerprint", 64 - width)
    pages = seeds.select(slot.alias("slot")).distinct().withColumn("page", F.shiftright("slot", page)).groupBy("page").applyInArrow(paint, "page long, bits binary")
    out = np.zeros((1 << (width - page), 1 << (page - 3)), dtype=np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def passing(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the fingerprints that the filter lets through."""
    width = (len(bits) * 8).bit_length() - 1
    slot = prints >> np.uint64(64 - width)
    return np.flatnonzero(bits[slot >> np.uint64(3)] & (np.uint8(128) >> (slot & np.uint64(7)).astype(np.uint8)))


def _reader(bits, seed: int) -> Callable:
    def read(batches):
        for b in batches:
            row, reading, place, prints = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for k, words in enumerate(readings(t)):
                    mine = fingerprints(word_ids(words), seed)
                    at = passing(mine, bits.value)
                    if len(at):
                        row.append(np.full(len(at), i))
                        reading.append(np.full(len(at), k, dtype=np.int32))
                        place.append(at.astype(np.int32))
                        prints.append(mine[at])
            if row:
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("doc_text").take(take), pa.array(np.concatenate(reading)), pa.array(np.concatenate(place)), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "doc_text", "reading", "doc_place", "fingerprint"])

    return read


def _tiler(seed: int, least: int) -> Callable:
    def tile(part: pa.Table) -> pa.Table:
        """The tiles of each pair of a document and an item, by reading."""
        pair, reading, doc, place = (part[c].to_numpy() for c in ("pair", "reading", "doc_place", "item_place"))
        doc, place = doc.astype(np.int64), place.astype(np.int64)
        order = np.lexsort((reading, pair))
        new = (np.diff(pair[order]) != 0) | (np.diff(reading[order]) != 0)
        best: dict[int, tuple[int, int, int]] = {}
        for rows in np.split(order, np.flatnonzero(new) + 1):
            got = tiles(diagonals(doc[rows], place[rows], seed), least)
            if got:
                key, first = int(pair[rows[0]]), int(rows[0])
                longest, covered, _ = best.get(key, (0, 0, first))
                best[key] = (max([longest, *(n for n, _, _ in got)]), max(covered, sum(n for n, _, _ in got)), first)
        longest, covered, rows = (np.array(x, dtype=np.int64) for x in zip(*best.values())) if best else [np.zeros(0, np.int64)] * 3
        one = part.take(pa.array(rows))
        words = one["n_words"].to_numpy()
        return pa.table([one["doc_id"], one["item_id"], pa.array(longest.astype(np.int32)), pa.array(covered.astype(np.int32)), one["n_words"], pa.array(covered / np.maximum(1, words))], names=["doc_id", "item_id", "longest", "covered", "n_words", "coverage"])

    return tile
