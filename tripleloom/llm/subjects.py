"""Subject areas of documents: bisecting k-means over normalised document vectors, leaves labelled by discriminative terms,
several subjects for a document by leaf mixtures.

Terms are words and neighbouring word pairs of a sentence, kept as 64-bit hashes. Terms that are unevenly spread over a
first guess of the subjects (hand labels, shelf codes) span the document vectors. Each leaf of the clustering is labelled by
how well its discriminative terms agree with those of the areas; a term's subjects are the mixture of the leaves it occurs
in; a sentence has the subject of its clear terms, a document those with a share of its subject-bearing sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.sentences import sentences
from tripleloom.runtime import spread, stored


@dataclass(frozen=True)
class Settings:
    leaves: int = 192
    dims: int = 128
    iterations: int = 8
    #: A term must be in this share of the documents (5 at least). As a document has some hundred distinct terms, no more
    #: than some hundred divided by this share can be kept, however many documents there are.
    least_share: float = 5e-4
    least_docs: int = 5
    #: z score and log lift from which a term is unevenly spread over the guessed subjects.
    least_z: float = 4.0
    least_lift: float = 0.7
    #: Share of a term's leaf mixture from which it is a clear sign of an area.
    clear: float = 0.55
    #: What a sentence needs: a term with this share of its mixture in the area, or several that are less clear.
    least_sign: float = 0.8
    #: Weight of the mixture of a document's leaf among the signs of its sentences.
    leaf_weight: float = 0.5
    #: Hand labels: of more documents than this, those with the smallest hash of their id are used.
    max_labelled: int = 200_000
    seed: int = 7


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def tokenised(docs: DataFrame, doc_id: str, text: str, guess: str | None) -> DataFrame:
    """doc_id, guess, words (hashes of all words in order), ends (end of each sentence), fresh (words first met in this
    task, for reading hashes back). Null and empty texts have no words."""
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, guess string, words array<bigint>, ends array<int>, fresh array<string>"

    def cut(batches):
        known: dict[str, int] = {}
        for b in batches:
            words, ends, fresh = [], [], []
            for t in b.column("text").to_pylist():
                row, at, new = [], [], []
                for s in sentences(t) if t else ():
                    for w in s:
                        h = known.get(w)
                        if h is None:
                            if len(known) >= 2_000_000:
                                known.clear()
                            h = known[w] = word_hash(w)
                            new.append(w)
                        row.append(h)
                    at.append(len(row))
                words.append(row)
                ends.append(at)
                fresh.append(new)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("guess"), pa.array(words, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())), pa.array(fresh, pa.list_(pa.string()))], names=["doc_id", "guess", "words", "ends", "fresh"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.lower(F.trim(F.col(f"`{guess}`"))) if guess else F.lit(None).cast("string")).alias("guess"), F.col(f"`{text}`").alias("text"))
    return stored(spread(rows).mapInArrow(cut, schema), "tokens")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of one stays small. A piece is copied to have offsets from 0."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.take(pa.array(np.arange(i, min(i + rows, b.num_rows))))


def terms_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Terms of a batch of tokenised rows with their row and their sentence (numbered through the batch), the row of each
    sentence and the number of sentences."""
    words, ends = batch.column("words"), batch.column("ends")
    w = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    n_words = np.diff(words.offsets.to_numpy())
    n_sents = np.diff(ends.offsets.to_numpy())
    row_of_sentence = np.repeat(np.arange(len(n_sents)), n_sents)
    start = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    stops = ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + start[row_of_sentence]
    sentence = np.searchsorted(stops, np.arange(len(w)), side="right")
    same = sentence[1:] == sentence[:-1]
    with np.errstate(over="ignore"):
        pairs = _mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])[same] if len(w) > 1 else w[:0]
    term = np.concatenate([w, pairs])
    sent = np.concatenate([sentence, sentence[1:][same]]) if len(w) > 1 else sentence
    return term, row_of_sentence[sent] if len(sent) else sent, sent, row_of_sentence, len(stops)


class Lookup:
    """Places of known terms: an open table on the hash's low bits narrows, the sorted terms decide."""

    def __init__(self, terms: np.ndarray):
        self.order = np.argsort(terms)
        self.sorted = terms[self.order]
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(terms))))) + 3)
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self._slot(terms)] = True

    def _slot(self, terms: np.ndarray) -> np.ndarray:
        return (terms & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``terms`` of the known ones, and their places."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[self._slot(terms)])
        at = np.searchsorted(self.sorted, terms[maybe])
        at[at == len(self.sorted)] = 0
        hit = self.sorted[at] == terms[maybe]
        return maybe[hit], self.order[at[hit]]


def term_statistics(tokens: DataFrame, masks: dict, areas: list[str]) -> DataFrame:
    """term, df, labelled, n (array: documents by guessed area) over all documents. masks: doc_id -> bits of its hand labels; other
    documents have the area that their guess is a beginning of."""
    shared = tokens.sparkSession.sparkContext.broadcast(masks)
    n_areas = len(areas)

    def count(batches):
        by_guess: dict = {None: 0, "": 0}
        for b in slices(batches):
            term, row, _, _, _ = terms_of(b)
            guesses, ids = b.column("guess").to_pylist(), b.column("doc_id").to_pylist()
            for g in set(guesses):
                if g not in by_guess:
                    fits = [i for i, a in enumerate(areas) if a.lower().startswith(g)]
                    by_guess[g] = 1 << fits[0] if len(fits) == 1 else 0
            mask = np.array([shared.value.get(i) or by_guess[g] for i, g in zip(ids, guesses)], dtype=np.int64)
            ends = np.cumsum(np.bincount(row, minlength=b.num_rows))
            order = np.argsort(row, kind="stable")
            own = [np.unique(t) for t in np.split(term[order], ends[:-1])]
            rows = np.repeat(np.arange(b.num_rows), [len(o) for o in own])
            names, at = np.unique(np.concatenate(own), return_inverse=True)
            out = np.zeros((len(names), n_areas), dtype=np.int32)
            m = mask[rows]
            for a in range(n_areas):
                out[:, a] = np.bincount(at[(m >> a) & 1 == 1], minlength=len(names))
            counts = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n_areas, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(at, minlength=len(names))), pa.array(np.bincount(at[m > 0], minlength=len(names))), counts], names=["term", "df", "labelled", "n"])

    parts = tokens.mapInArrow(count, "term long, df long, labelled long, n array<int>")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("labelled").alias("labelled"), *(F.sum(F.col("n")[a]).alias(f"n{a}") for a in range(n_areas)))


@dataclass(frozen=True)
class Features:
    terms: np.ndarray
    idf: np.ndarray
    lift: np.ndarray
    by_area: np.ndarray
    labelled: np.ndarray
    base: np.ndarray


def choose_features(statistics: DataFrame, n_docs: int, n_labelled: int, of_area: np.ndarray, s: Settings) -> Features:
    """The terms that are unevenly spread over the guessed areas."""
    base = of_area / max(1, n_labelled)
    least = max(s.least_docs, s.least_share * n_docs)
    uneven = F.lit(False)
    for a, p in enumerate(base):
        if p > 0:
            e = F.col("labelled") * F.lit(float(p))
            z = (F.col(f"n{a}") - e) / F.sqrt(e * F.lit(float(1 - p)) + 0.5)
            uneven = uneven | ((z > s.least_z) & (F.log((F.col(f"n{a}") + 1) / (e + 1)) > s.least_lift))
    got = statistics.where((F.col("df") >= least) & uneven).orderBy("term").toArrow()
    n = np.stack([got[f"n{a}"].to_numpy() for a in range(len(base))], axis=1).astype(np.float64) if got.num_rows else np.zeros((0, len(base)))
    labelled = got["labelled"].to_numpy().astype(np.float64)
    e = labelled[:, None] * base[None, :]
    z = (n - e) / np.sqrt(e * (1 - base) + 0.5)
    lift = np.where(z > 3, np.clip(np.log((n + 1) / (e + 1)), 0, None), 0)
    return Features(got["term"].to_numpy().view(np.uint64), np.log(max(2, n_docs) / np.maximum(1, got["df"].to_numpy())), lift, n, labelled, base)


def document_vectors(tokens: DataFrame, features: Features, s: Settings) -> DataFrame:
    """doc_id, vector (unit length), places and sentences (of each occurrence of a feature in the document, in order): signed random
    projections of term weights; documents without features are left out. A term's signs are bits of its hash."""
    shared = tokens.sparkSession.sparkContext.broadcast((features.terms, features.idf))
    words = -(-s.dims // 64)

    def project(batches):
        terms, idf = shared.value
        find = Lookup(terms)
        steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = _mix(terms[:, None] + steps[None, :])
        signs = (np.unpackbits(bits.view(np.uint8), axis=1)[:, : s.dims] * 2).view(np.int8) - np.int8(1)
        for b in slices(batches):
            term, row, sent, row_of, _ = terms_of(b)
            at, place = find(term)
            mine, sent = row[at], sent[at]
            key, tf = np.unique(mine * len(terms) + place, return_counts=True)
            r, f = key // max(1, len(terms)), key % max(1, len(terms))
            rows, first = np.unique(r, return_index=True)
            if not len(rows):
                continue
            weight, stops = ((1 + np.log(tf)) * idf[f]).astype(np.float32), np.append(first, len(f))
            v = np.empty((len(rows), s.dims), dtype=np.float32)
            for i in range(0, len(rows), 256):
                lo, hi = stops[i], stops[min(i + 256, len(rows))]
                v[i : i + 256] = np.add.reduceat(weight[lo:hi, None] * signs[f[lo:hi]], first[i : i + 256] - lo, axis=0)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            order = np.lexsort((sent, mine))
            ends = np.append(np.searchsorted(mine[order], rows), len(order)).astype(np.int32)
            starts = np.searchsorted(row_of, np.arange(b.num_rows))  # first sentence of each row
            own = (sent - starts[mine])[order].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(rows)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, s.dims, dtype=np.int32)), pa.array(v.ravel())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(own)),
                ],
                names=["doc_id", "vector", "places", "sentences"],
            )

    return stored(tokens.mapInArrow(project, f"doc_id {dict(tokens.dtypes)['doc_id']}, vector array<float>, places array<int>, sentences array<int>"), "vectors")


@dataclass(frozen=True)
class Leaves:
    sizes: np.ndarray
    terms: np.ndarray  # leaf x feature: documents
    disc: np.ndarray  # leaf x feature: discriminative weight
    mixture: np.ndarray  # leaf x area
    placed: DataFrame  # doc_id, leaf, places, sentences


def cluster(vectors: DataFrame, features: Features, s: Settings) -> Leaves:
    """Bisecting k-means over all document vectors; each leaf labelled by its discriminative terms."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    # The fit keeps the vectors in memory for its passes by itself, and in a better form than a persisted table has; the rest
    # of the rows is read once, to be placed.
    points = vectors.select(array_to_vector("vector").alias("features"))
    model = BisectingKMeans(k=s.leaves, maxIter=s.iterations, seed=s.seed, minDivisibleClusterSize=4.0).fit(points)
    rows = vectors.select("doc_id", array_to_vector("vector").alias("features"), "places", "sentences")
    placed = stored(model.transform(rows).select("doc_id", F.col("prediction").alias("leaf"), "places", "sentences"), "placed")
    counted = placed.select("leaf", F.explode(F.concat(F.array(F.lit(-1)), F.array_distinct("places"))).alias("f")).groupBy("leaf", "f").count().toArrow()
    leaf, f, n = (counted[c].to_numpy() for c in ("leaf", "f", "count"))
    k = int(leaf.max()) + 1
    sizes, terms = np.zeros(k), np.zeros((k, len(features.terms)), dtype=np.float32)
    sizes[leaf[f < 0]] = n[f < 0]
    terms[leaf[f >= 0], f[f >= 0]] = n[f >= 0]
    total, docs = terms.sum(axis=0), max(1.0, sizes.sum())
    disc, usual = np.zeros_like(terms), np.log((total + 0.5) / (docs + 1))
    for i in range(k):
        expected = sizes[i] * total / docs
        odds = np.log((terms[i] + 0.5) / (sizes[i] + 1)) - usual
        disc[i] = np.where((odds > 0.5) & ((terms[i] - expected) / np.sqrt(expected + 0.5) > 2), odds * np.sqrt(terms[i]), 0)
    mixture = (disc @ features.lift) ** 2
    mixture /= np.maximum(mixture.sum(axis=1, keepdims=True), 1e-12)
    squared = mixture**2
    return Leaves(sizes, terms, disc, squared / np.maximum(squared.sum(axis=1, keepdims=True), 1e-12), placed)


def term_subjects(leaves: Leaves, features: Features) -> np.ndarray:
    """feature x area: the mixture of the leaves that a term occurs in, weighed by how the term is spread over the labelled
    documents; rows sum to 1."""
    share = leaves.terms / np.maximum(leaves.terms.sum(axis=0), 1)
    by_leaf = share.T @ leaves.mixture
    base = np.maximum(features.base, 1e-9)
    by_label = (features.by_area + 3 * base) / (features.labelled + 3)[:, None] / base
    w = by_leaf * by_label
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)


def sentence_shares(leaves: Leaves, weights: np.ndarray, s: Settings) -> DataFrame:
    """doc_id, area (place), n_sentences with the area, n_bearing (subject-bearing sentences): one row for each area that any sentence of
    the row's document deals with. The mixture of the document's leaf is the first estimate, which clear terms add to."""
    n_areas = weights.shape[1]
    usual = 1 / n_areas + 0.02
    logs = np.where(weights.max(axis=1, keepdims=True) >= s.clear, np.log((weights + 0.02) / usual), 0).astype(np.float32)
    first = s.leaf_weight * np.log((leaves.mixture + 0.02) / usual)
    least = float(np.log((s.least_sign + 0.02) / usual))
    shared = leaves.placed.sparkSession.sparkContext.broadcast((logs, first, logs.any(axis=1)))

    def assign(batches):
        w, prior, clear = shared.value
        for b in slices(batches):
            places, ends = b.column("places"), b.column("places").offsets.to_numpy()
            place = places.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            sent = b.column("sentences").flatten().to_numpy()
            keep = np.flatnonzero(clear[place])
            if not len(keep):
                continue
            new = np.r_[True, (np.diff(row[keep]) != 0) | (np.diff(sent[keep]) != 0)]
            start = np.flatnonzero(new)
            row = row[keep][start]
            signs = np.add.reduceat(w[place[keep]], start, axis=0)
            bearing = signs.max(axis=1) >= least
            row, signs = row[bearing], signs[bearing]
            if not len(row):
                continue
            area = (signs + prior[b.column("leaf").to_numpy()[row]]).argmax(axis=1)
            total = np.bincount(row, minlength=b.num_rows)
            key, count = np.unique(row * n_areas + area, return_counts=True)
            r = key // n_areas
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(r)), pa.array((key % n_areas).astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(total[r].astype(np.int64))], names=["doc_id", "area", "n_sentences", "n_bearing"])

    return leaves.placed.mapInArrow(assign, f"doc_id {dict(leaves.placed.dtypes)['doc_id']}, area int, n_sentences long, n_bearing long")


@dataclass(frozen=True)
class Subjects:
    shares: DataFrame
    tokens: DataFrame
    features: Features
    leaves: Leaves | None
    areas: list[str]


def subjects(docs: DataFrame, labels: DataFrame, areas: list[str], doc_id: str = "doc_id", text: str = "text", guess: str | None = "shelf_code", settings: Settings = Settings()) -> Subjects:
    """Shares of the subject areas in each document: doc_id, area, n_sentences, n_bearing, share.

    labels: doc_id and area, a sample that may be wrong in places; unknown and null areas are left out. guess: a column with a
    beginning of an area's name, or None. Documents without subject-bearing sentences (null and empty texts, too) have no
    row. Each row of a repeated doc_id is a document of its own. Without labels and guesses, or without documents, there
    are no rows. Other columns are ignored."""
    s, spark = settings, docs.sparkSession
    names = sorted({a for a in areas if a})
    place = {a.strip().lower(): i for i, a in enumerate(names)}
    tokens = tokenised(docs, doc_id, text, guess)
    masks: dict = {}
    known = labels.select(F.col("doc_id").alias("d"), F.lower(F.trim("area")).alias("a")).where(F.col("d").isNotNull() & F.col("a").isin(list(place))).distinct()
    ids = known.select("d").distinct().orderBy(F.xxhash64("d")).limit(s.max_labelled)
    for d, a in known.join(ids, "d", "left_semi").toLocalIterator():
        masks[d] = masks.get(d, 0) | 1 << place[a]
    statistics = stored(term_statistics(tokens, masks, names), "statistics")
    n_docs, n_labelled, of_area = _class_sizes(tokens, masks, names)
    features = choose_features(statistics, n_docs, n_labelled, of_area, s)
    schema = f"doc_id {dict(tokens.dtypes)['doc_id']}, area string, n_sentences long, n_bearing long, share double"
    vectors = document_vectors(tokens, features, s) if len(features.terms) else None
    if vectors is None or not vectors.limit(1).count():
        return Subjects(spark.createDataFrame([], schema), tokens, features, None, names)
    leaves = cluster(vectors, features, s)
    found = sentence_shares(leaves, term_subjects(leaves, features), s)
    name = F.array(*(F.lit(a) for a in names))
    shares = found.select(F.col("doc_id").alias(doc_id), name[F.col("area")].alias("area"), "n_sentences", "n_bearing", (F.col("n_sentences") / F.col("n_bearing")).alias("share"))
    return Subjects(shares, tokens, features, leaves, names)


def _class_sizes(tokens: DataFrame, masks: dict, areas: list[str]) -> tuple[int, int, np.ndarray]:
    """Numbers of documents, of those with a guessed area, and of those of each area."""
    shared = tokens.sparkSession.sparkContext.broadcast(masks)

    def bits(batches):
        for b in batches:
            got = [shared.value.get(i) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), b.column(1)], names=["mask", "guess"])

    counted = tokens.select("doc_id", "guess").mapInArrow(bits, "mask long, guess string").groupBy("mask", "guess").count().collect()
    n, labelled, of_area = 0, 0, np.zeros(len(areas))
    for r in counted:
        mask = r["mask"] or 0
        if not mask and r["guess"]:
            fits = [i for i, a in enumerate(areas) if a.lower().startswith(r["guess"])]
            mask = 1 << fits[0] if len(fits) == 1 else 0
        n += r["count"]
        labelled += r["count"] * (mask > 0)
        for i in range(len(areas)):
            of_area[i] += r["count"] * (mask >> i & 1)
    return n, labelled, of_area


def leaf_report(result: Subjects, top: int = 10) -> DataFrame:
    """leaf, n_docs, area, weight, terms: the areas of each leaf's mixture (5 % at least) and its most discriminative words."""
    spark = result.tokens.sparkSession
    schema = "leaf int, n_docs long, area string, weight double, terms array<string>"
    if result.leaves is None:
        return spark.createDataFrame([], schema)
    best = [np.argsort(-d)[: 3 * top] for d in result.leaves.disc]
    wanted = sorted({int(result.features.terms[f].view(np.int64)) for row in best for f in row})
    hashes = spark.createDataFrame([(h,) for h in wanted], "h long")

    def read(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_hash(w) for w in words], pa.int64())], names=["word", "h"])

    words = result.tokens.select(F.explode("fresh").alias("word")).distinct().mapInArrow(read, "word string, h long").join(F.broadcast(hashes), "h")
    names = {r["h"]: r["word"] for r in words.groupBy("h").agg(F.min("word").alias("word")).collect()}
    rows = []
    for k, (n, mix, order) in enumerate(zip(result.leaves.sizes, result.leaves.mixture, best)):
        terms = [names[h] for f in order if result.leaves.disc[k][f] > 0 and (h := int(result.features.terms[f].view(np.int64))) in names][:top]
        rows += [(k, int(n), a, float(w), terms) for a, w in zip(result.areas, mix) if w >= 0.05]
    return spark.createDataFrame(rows, schema)
