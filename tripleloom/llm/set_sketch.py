"""Distinct counts over huge identifier sets by registers on a logarithmic scale with tunable base.

An element draws for each of m registers an exponential value of rate a, the same wherever it is seen; a register keeps
the largest floor(1 - log_b(value)). Two sketches merge by maximum. The relative standard error is about 1/sqrt(m) for
bases near 1. Draws come in ascending order and end where they can't raise a register any more. Sets of very few elements
are kept as plain lists of hashes, and are exact but for hash collisions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.runtime import stored

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Scale:
    """m registers of one byte, base b, rate a. b = 1.14 reaches sets of about 10^12 elements. Sets of up to ``sparse``
    elements are kept as plain lists of hashes."""

    m: int = 512
    b: float = 1.14
    a: float = 20.0
    sparse: int = 32

    @property
    def rsd(self) -> float:
        """Relative standard error of a cardinality: 3.1 % at m = 1024, 4.4 % at 512."""
        return float(np.sqrt(((self.b + 1) / (self.b - 1) * np.log(self.b) - 1) / self.m))

    def level(self, x: np.ndarray) -> np.ndarray:
        """Register values of exponential draws."""
        return np.clip(np.floor(1 - np.log(x) / np.log(self.b)), 0, 255).astype(np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Elements that are drawn for at once: with up to 32 draws each, some MB.
CHUNK = 1 << 12


def draws(hashes: np.ndarray, limit: np.ndarray, scale: Scale) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The draws of each element in ascending order up to its limit: places of the elements, registers, values.

    An element's draws are a Poisson process of rate a m whose points fall on registers at random, so that the first point
    of each register is exponential of rate a, independently of the others. All follow from the hash alone: 44 bits of a mixed
    word give the distance to the point before, 20 others the register."""
    at, h, x = np.arange(len(hashes)), hashes.astype(np.uint64), np.zeros(len(hashes))
    done, size = 0, 1
    with np.errstate(over="ignore"):
        while len(at):
            # Blocks of 1, 1, 2, 4, … 32 draws, the same for every element, so that its draws are the same wherever it is.
            steps = np.arange(done + 1, done + size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            word = _mix(h[:, None] + steps)
            values = x[:, None] + np.cumsum(np.log(((word >> np.uint64(20)) + 0.5) / float(1 << 44)) / -(scale.a * scale.m), axis=1)
            row, col = np.nonzero(values <= limit[:, None])
            register = ((word[row, col] & np.uint64(0xFFFFF)) * np.uint64(scale.m)) >> np.uint64(20)
            yield at[row], register.astype(np.int64), values[row, col]
            x = values[:, -1]
            keep = np.flatnonzero(x <= limit)
            at, h, x, limit = at[keep], h[keep], x[keep], limit[keep]
            done, size = done + size, min(32, max(1, done + size))


def fill(registers: np.ndarray, slot: np.ndarray, hashes: np.ndarray, scale: Scale) -> None:
    """Puts elements into the rows ``slot`` (in ascending order) of the registers.

    Draws above a limit are left out at first: what could still raise a register lies below b^-(smallest register), and a row
    of n new elements has almost surely a draw below (ln m + 4) / (a n) in every register. Rows where that turns out to be
    wrong are drawn again with twice the limit, so the result is that of all draws; the work for a row is about
    m (ln m + 4) draws and one for each element, not m for each."""
    n = np.bincount(slot, minlength=len(registers))
    ceiling = float(scale.b)  # draws above are worth 0
    limit = np.minimum(ceiling, (np.log(scale.m) + 4) / (scale.a * np.maximum(n, 1)))
    limit = np.minimum(limit, scale.b ** -registers.min(axis=1).astype(float)) if len(registers) else limit
    left = np.arange(len(slot))
    while len(left):
        for i in range(0, len(left), CHUNK):
            some = left[i : i + CHUNK]
            s = slot[some]
            low, high = int(s[0]), int(s[-1]) + 1
            # The smallest draw of each register decides, so that levels are taken once for each.
            least = np.full((high - low) * scale.m, np.inf)
            for at, register, x in draws(hashes[some], limit[s], scale):
                np.minimum.at(least, (s[at] - low) * scale.m + register, x)
            np.maximum(registers[low:high], scale.level(least).reshape(-1, scale.m), out=registers[low:high])
        unsure = (limit < ceiling) & (registers.min(axis=1) < scale.level(limit))
        left = left[unsure[slot[left]]]
        limit = np.where(unsure, np.minimum(ceiling, 2 * limit), limit)


def registers_of(hashes: np.ndarray, scale: Scale) -> np.ndarray:
    """One row of m bytes for each 64-bit hash."""
    out = np.zeros((len(hashes), scale.m), dtype=np.uint8)
    fill(out, np.arange(len(hashes)), hashes, scale)
    return out


def cardinality(registers: np.ndarray, scale: Scale) -> np.ndarray:
    """Estimated number of elements of each row of registers."""
    power = np.power(scale.b, -np.arange(256.0))
    return scale.m * (1 - 1 / scale.b) / (scale.a * np.log(scale.b) * power[registers].sum(axis=1))


def joint(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, scale: Scale) -> dict[str, np.ndarray]:
    """Union, intersection and Jaccard similarity of the sets of each row of registers x and y, with standard errors.

    The similarity is that of maximum likelihood given the numbers of registers in which x is above, below or equal to y; its
    error comes from the Fisher information. Union and intersection follow from it and the two cardinalities, and their
    errors by propagation: that of the cardinalities (taken as fully correlated, the worst case) and that of the similarity."""
    above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = scale.m - above - below
    u, v = n_x / (n_x + n_y), n_y / (n_x + n_y)
    top = np.minimum(u / v, v / u)

    def p(z):
        return -np.log1p(-z * (scale.b - 1) / scale.b) / np.log(scale.b)

    def parts(j):
        hi, lo = np.maximum(p(u - v * j), 1e-15), np.maximum(p(v - u * j), 1e-15)
        return hi, lo, np.maximum(1 - hi - lo, 1e-15)

    def loglik(j):
        hi, lo, eq = parts(j)
        return above * np.log(hi) + below * np.log(lo) + equal * np.log(eq)

    left, right = np.zeros(len(top)), top.copy()
    for _ in range(60):
        a, c = left + (right - left) / 3, right - (right - left) / 3
        less = loglik(a) < loglik(c)
        left, right = np.where(less, a, left), np.where(less, right, c)
    j = (left + right) / 2
    d = np.maximum(1e-6, 1e-4 * top)
    lo, hi = np.maximum(0.0, j - d), np.minimum(top, j + d)
    slopes = [(q - r) / np.maximum(hi - lo, 1e-12) for q, r in zip(parts(hi), parts(lo))]
    info = scale.m * sum(s * s / q for s, q in zip(slopes, parts(j)))
    error = np.where(info > 0, 1 / np.sqrt(np.maximum(info, 1e-300)), 0.0)
    total = n_x + n_y
    union = total / (1 + j)
    return {
        "n_union": union,
        "n_both": union * j,
        "jaccard": j,
        "jaccard_error": error,
        "union_error": union * np.hypot(scale.rsd, error / (1 + j)),
        "both_error": np.hypot(union * j * scale.rsd, total * error / (1 + j) ** 2),
    }


def levels(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """Every combination of the dimensions, the empty one first."""
    return [c for n in range(len(dims) + 1) for c in combinations(dims, n)]


def _binary(lengths: np.ndarray, data: np.ndarray, present: np.ndarray) -> pa.Array:
    """Binary column of rows of the given byte lengths laid end to end; null where not present."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    bits = np.packbits(present, bitorder="little")
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [pa.py_buffer(bits.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def _content(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the values of a binary column that aren't null, and their bytes end to end."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    values = values.drop_null()
    _, offsets, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(len(values), np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.diff(at), np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def fold(group: np.ndarray, hashes: np.ndarray, n_groups: int, scale: Scale, registers: np.ndarray | None = None, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sketches of (group, element) pairs, added to the registers of the groups that are dense already: the number of distinct
    elements, the hashes of sparse groups in group order, which groups are dense, and the registers of these in group order."""
    order = np.lexsort((hashes, group))
    g, h = group[order], hashes[order]
    if len(g):
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        g, h = g[new], h[new]
    n = np.bincount(g, minlength=n_groups)
    known = np.zeros(n_groups, dtype=bool) if dense is None else dense
    dense = known | (n > scale.sparse)
    slot = np.cumsum(dense) - 1
    regs = np.zeros((int(dense.sum()), scale.m), dtype=np.uint8)
    if registers is not None:
        regs[slot[known]] = registers
    mine = dense[g]
    fill(regs, slot[g[mine]], h[mine], scale)
    return n, h[~mine], dense, regs


def group_codes(codes: Sequence[tuple[np.ndarray, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows with several codes, each below its number of values: first row and group number of each distinct combination.
    Codes are renumbered before their product could leave 64 bits."""
    key, top = np.zeros(n, dtype=np.int64), 1
    for code, size in codes:
        size = max(1, size)
        if top > (1 << 62) // size:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key, top = key * size + code, top * size
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return first, group


def _encoded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes and values of a column; null is a value."""
    enc = column.combine_chunks().dictionary_encode(null_encoding="encode")
    enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def _columns(n: np.ndarray, sparse: np.ndarray, dense: np.ndarray, regs: np.ndarray, m: int) -> list[pa.Array]:
    """hashes, registers, n."""
    return [_binary(np.where(dense, 0, n * 8), sparse, ~dense), _binary(np.where(dense, m, 0), regs, dense), pa.array(n, mask=dense, type=pa.int64())]


#: Leads that the driver counts at once (days are few); of more, only the number of parts of the hot ones is kept, as a table.
MAX_LEADS = 10_000


def _hot_leads(counted: DataFrame, task_rows: int, task_share: float) -> DataFrame:
    """hot (a lead), salts: the leads that are split, and the number of their parts."""
    few = counted.limit(MAX_LEADS + 1).collect()
    if len(few) <= MAX_LEADS:
        limit = max(1, min(task_rows, math.ceil(task_share * sum(r["c"] for r in few))))
        rows = [(r["lead"], -(-r["c"] // limit)) for r in few if r["c"] > limit]
        return F.broadcast(counted.sparkSession.createDataFrame(rows, f"hot {dict(counted.dtypes)['lead']}, salts long"))
    counted = stored(counted, "leads")
    limit = max(1, min(task_rows, math.ceil(task_share * counted.agg(F.sum("c")).first()[0])))
    return counted.where(F.col("c") > limit).select(F.col("lead").alias("hot"), F.ceil(F.col("c") / limit).alias("salts"))


def distinct_sketches(df: DataFrame, element: str, lead: str, dims: Sequence[str], scale: Scale = Scale(), combos: Sequence[tuple[str, ...]] | None = None, task_rows: int = 2_000_000, task_share: float = 1 / 64) -> DataFrame:
    """A mergeable partial result for each value of ``lead`` (as a day) with each combination of values of ``dims``.

    dimensions (names of the grouped dims, joined by +; '' for the lead alone), lead, the dims (null where not grouped),
    hashes (sparse sets) or registers (dense sets), and n: the count that was found on the way for sparse sets.
    A lead with more rows than ``task_rows``, or more than ``task_share`` of all, is split into parts, each sketched in a task of
    its own, and these are merged by ``merged``. A row's part follows from its element and from the split of the input that
    it is read in, so that neither a hot element nor equal rows are all in one part.
    Null elements count for nothing; null leads and null dims are groups of their own. No rows give no rows."""
    combos = levels(dims) if combos is None else list(combos)
    names = [f"d{i}" for i in range(len(dims))]
    rows = df.select(F.col(f"`{lead}`").alias("lead"), *(F.col(f"`{d}`").alias(x) for x, d in zip(names, dims)), F.xxhash64(F.col(f"`{element}`")).alias("h"), F.col(f"`{element}`").isNull().alias("none")).where("NOT none").drop("none")
    hot = _hot_leads(rows.groupBy("lead").agg(F.count(F.lit(1)).alias("c")), task_rows, task_share)
    kinds = dict(rows.dtypes)
    masks = [[dims.index(d) for d in c] for c in combos]
    labels = ["+".join(c) for c in combos]

    def sketch(part: pa.Table) -> pa.Table:
        hashes = part["h"].to_numpy().view(np.uint64)
        codes, values = zip(*(_encoded(part[d]) for d in names)) if names else ((), ())
        out = []
        for mask, label in zip(masks, labels):
            first, group = group_codes([(codes[i], len(values[i])) for i in mask], len(hashes))
            n, sparse, dense, regs = fold(group, hashes, len(first), scale)
            cols = [pa.array([label] * len(first), pa.string()), part["lead"].take(pa.array(np.zeros(len(first), dtype=np.int64)))]
            for i in range(len(names)):
                cols.append(values[i].take(pa.array(codes[i][first])) if i in mask else pa.nulls(len(first), values[i].type))
            cols += [*_columns(n, sparse, dense, regs, scale.m), part["salts"].take(pa.array(np.zeros(len(first), dtype=np.int64)))]
            out.append(pa.table(cols, names=["dimensions", "lead", *names, "hashes", "registers", "n", "salts"]))
        return pa.concat_tables(out)

    schema = f"dimensions string, lead {kinds['lead']}, " + "".join(f"{d} {kinds[d]}, " for d in names) + "hashes binary, registers binary, n long, salts long"
    salted = rows.join(hot, F.col("lead").eqNullSafe(F.col("hot")), "left").select("lead", *names, "h", F.coalesce("salts", F.lit(1)).alias("salts"))
    part = F.pmod(F.xxhash64("h", F.spark_partition_id()), "salts").alias("salt")
    parts = stored(salted.select("*", part).groupBy("lead", "salt").applyInArrow(sketch, schema), "partials")
    parts = parts.select("dimensions", F.col("lead").alias(lead), *(F.col(x).alias(d) for x, d in zip(names, dims)), "hashes", "registers", "n", "salts")
    split = parts.where("salts > 1").drop("salts")
    return parts.where("salts = 1").drop("salts").unionByName(stored(merged(split, ["dimensions", lead, *dims], scale, split.count()), "merged"))


def merged(parts: DataFrame, keys: Sequence[str], scale: Scale = Scale(), rows: int | None = None, bucket_rows: int = 20_000) -> DataFrame:
    """One sketch for each group of equal ``keys`` (null equals null): registers by maximum, lists of hashes as sets.

    Equal groups are first folded within each of the parts' partitions, so many parts of one group don't meet in one task; what
    is left is merged in buckets by hash of the keys of about ``bucket_rows`` parts, of which a task takes one at a time.
    rows: the number of parts; where it isn't given, the parts are stored to count them. No rows give no rows."""
    if rows is None:
        parts = stored(parts, "parts")
        rows = parts.count()
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", hashes binary, registers binary, n long"

    def merge(part: pa.Table) -> pa.Table:
        codes = [_encoded(part[k]) for k in keys]
        first, group = group_codes([(c, len(v)) for c, v in codes], part.num_rows)
        known = np.zeros(len(first), dtype=bool)
        full = np.flatnonzero(part["registers"].is_valid().to_numpy())
        known[group[full]] = True
        regs = None
        if len(full):
            rows = _content(part["registers"])[1].reshape(-1, scale.m)
            order = np.argsort(group[full], kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(group[full][order]) > 0])
            regs = np.maximum.reduceat(rows[order], starts, axis=0)
        own = np.flatnonzero(part["hashes"].is_valid().to_numpy())
        lengths, data = _content(part["hashes"])
        h, g = np.frombuffer(data.tobytes(), np.uint64), np.repeat(group[own], lengths // 8)
        n, sparse, dense, regs = fold(g, h, len(first), scale, regs, known)
        cols = [part[k].take(pa.array(first)) for k in keys]
        return pa.table([*cols, *_columns(n, sparse, dense, regs, scale.m)], names=[*keys, "hashes", "registers", "n"])

    def first_fold(batches):
        for b in batches:
            if b.num_rows:
                yield from merge(pa.Table.from_batches([b])).to_batches()

    folded = parts.select(*keys, "hashes", "registers", "n").mapInArrow(first_fold, schema)
    buckets = max(1, -(-rows // bucket_rows))
    hashed = F.pmod(F.xxhash64(*(F.col(f"`{k}`").isNull() for k in keys), *(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).alias("_bucket")
    return folded.select("*", hashed).groupBy("_bucket").applyInArrow(lambda t: merge(t.drop_columns(["_bucket"])), schema)


def rolled_up(sketches: DataFrame, lead: str, dims: Sequence[str], scale: Scale = Scale()) -> DataFrame:
    """The sketches (stored ones, as ``distinct_sketches`` gives them) of each value of ``lead`` and, merged from them, those over all of
    its values (null ones too).

    ``dimensions`` begins with the lead's name where it is grouped by; elsewhere the lead is null and, without dims, the names
    are empty: the grand total. No rows give no rows."""
    own = sketches
    over = merged(own, ["dimensions", *dims], scale, own.count()).withColumn(lead, F.lit(None).cast(dict(own.dtypes)[lead]))
    named = F.concat_ws("+", F.lit(lead), F.when(F.col("dimensions") != "", F.col("dimensions")))
    return own.withColumn("dimensions", named).unionByName(over)


def estimated(sketches: DataFrame, scale: Scale = Scale(), z: float = 1.96) -> DataFrame:
    """Replaces the sketch by n_distinct, low and high: the bound of z standard errors (95 % for 1.96); exact sets have all
    three equal."""
    kept = [c for c in sketches.columns if c not in ("hashes", "registers", "n")]
    kinds = dict(sketches.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_distinct double, low double, high double"
    rsd = scale.rsd

    def count(batches):
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False).astype(float)
            dense = np.isnan(n)
            if dense.any():
                regs = _content(b.column("registers"))[1].reshape(-1, scale.m)
                n[dense] = cardinality(regs, scale)
            wide = np.where(dense, z * rsd, 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n), pa.array(n / (1 + wide)), pa.array(n / np.maximum(1 - wide, 1e-9))], names=[*kept, "n_distinct", "low", "high"])

    return sketches.select(*kept, "registers", "n").mapInArrow(count, schema)


OVERLAP = ["n_left", "n_right", "n_union", "n_both", "jaccard", "jaccard_error", "union_error", "both_error"]


def overlaps(pairs: DataFrame, left: str, right: str, scale: Scale = Scale()) -> DataFrame:
    """Adds n_left, n_right, n_union, n_both, jaccard and the standard errors jaccard_error, union_error and both_error for the
    sketches in the struct columns ``left`` and ``right`` (fields hashes, registers). Two lists of hashes are compared
    exactly (errors 0), else by maximum likelihood, all pairs of a batch at once."""
    kept = [c for c in pairs.columns if c not in (left, right)]
    kinds = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} double" for c in OVERLAP)])

    def side(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Registers of each row, its cardinality, whether it is a list, and the lists."""
        lists, regs = column.field("hashes").to_pylist(), column.field("registers").to_pylist()
        few = np.array([r is None for r in regs], dtype=bool)
        out = np.zeros((len(regs), scale.m), dtype=np.uint8)
        if not few.all():
            out[~few] = np.frombuffer(b"".join(r for r in regs if r is not None), np.uint8).reshape(-1, scale.m)
        sizes = np.array([len(x or b"") // 8 for x in lists], dtype=np.int64)
        n = sizes.astype(float)
        n[~few] = cardinality(out[~few], scale)
        return out, n, few, [np.frombuffer(x or b"", np.uint64) for x in lists]

    def compare(batches):
        for b in batches:
            if not b.num_rows:
                continue
            (x, n_x, few_x, list_x), (y, n_y, few_y, list_y) = side(b.column(left)), side(b.column(right))
            got = {c: np.zeros(b.num_rows) for c in OVERLAP} | {"n_left": n_x, "n_right": n_y, "n_union": n_x + n_y}
            both = few_x & few_y
            for i in np.flatnonzero(both):
                common = len(np.intersect1d(list_x[i], list_y[i]))
                union = n_x[i] + n_y[i] - common
                got["n_union"][i], got["n_both"][i], got["jaccard"][i] = union, common, common / union if union else 0.0
            mixed = np.flatnonzero(~both & (n_x > 0) & (n_y > 0))
            for regs, few, lists in ((x, few_x, list_x), (y, few_y, list_y)):
                mine = mixed[few[mixed]]
                fill(regs, np.repeat(mine, [len(lists[i]) for i in mine]), np.concatenate([lists[i] for i in mine]) if len(mine) else np.zeros(0, np.uint64), scale)
            if len(mixed):
                for c, values in joint(x[mixed], y[mixed], n_x[mixed], n_y[mixed], scale).items():
                    got[c][mixed] = values
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(got[c]) for c in OVERLAP)], names=[*kept, *OVERLAP])

    return pairs.mapInArrow(compare, schema)
