"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

1. Labelled examples (``EXAMPLES`` at most per class, ``EXAMPLE_BYTES`` of text at most per class, in the order of a hash of
   the id) give the vocabulary: every word of theirs. A text longer than what is left of that bound is no example.
2. Document frequencies of these words are counted over all documents, and by class over all labelled learning texts outside
   the calibration fold, copies of a text once. A word's weight is its idf times a power of its likelihood ratio between the
   classes. The power is one of ``POWERS``; 0 is plain TF-IDF. Each is tried on the calibration fold, which is part of the
   learning rows, and the one with the least log loss is taken. Words of no example are not counted in a text's length; no
   example could share them.
3. The examples become unit vectors in a block-max inverted index: postings are cut into blocks of ``BLOCK_ROWS`` examples,
   and each frequent word knows its largest weight in each block. Short lists are added up at once. What they give, plus the
   largest weights of the frequent words, bounds a block's cosines; a block whose bound is below the running cosine of the
   ``NEIGHBOURS``-th example is skipped. Examples stand in the order of their heaviest word, so that blocks are alike.
4. The nearest vote with their cosine as weight. Votes are calibrated by a logistic fit on the calibration fold. If that
   is not of both classes, the share of toxic votes is the score. A model that learned no toxic or no clean text has nothing
   to tell them apart by: all its texts score 0 and are predicted clean.

The index is bounded by the examples whatever the tables' sizes, and is the only thing sent to the tasks. No text is
shuffled: ids and hashes say which labelled texts count, and their words travel as packed numbers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize
from . import text as tx
from .near_duplicates import MAP_BITS
from .near_duplicates import _only as only_ids

EXAMPLES, EXAMPLE_BYTES = 3000, 32 << 20
NEIGHBOURS = 15
#: Powers of the likelihood ratio that are tried as a factor of a word's weight.
POWERS = (0.0, 0.5, 1.0)
#: Weight of the base rate among the votes: few or far neighbours say little.
PRIOR = 0.5
#: A word that more than one in so many examples have is frequent; examples of a block, blocks looked at before the others.
OFTEN, BLOCK_ROWS, FIRST_BLOCKS = 16, 64, 4
#: Bytes of text whose words are looked at together (or one longer text): work arrays take some 50 times that.
PIECE = 1 << 18
#: Cosines held at a time.
CELLS = 1 << 21
CALIBRATION_SHARE = 4
#: More than what a bound can lose by rounding.
SLACK = 1e-5


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tx.Words]:
    words = tx.split_words(data, offsets, tx.MARKS, tx.LOWER)
    return words.hashes(), words


def _term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) in the order of the texts."""
    h, words = _terms(data, offsets)
    doc = words.doc_of_words()
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


class _Vocabulary:
    """Sorted terms, and a sieve that keeps most other words from the search."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[terms >> np.uint64(42)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h``, terms' numbers) of the words that are terms."""
        maybe = np.flatnonzero(self.sieve[h >> np.uint64(42)])
        if not len(self.terms):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == h[maybe]
        return maybe[hit], at[hit]


def _frequencies(terms):
    """Number of the term, texts that hold it; term -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(terms.value)
        v = len(terms.value)
        total, texts = np.zeros(v, dtype=np.int64), 0
        for batch in batches:
            for rows, data, offsets in tx.text_pieces(batch, "_text", PIECE):
                h, words = _terms(data, offsets)
                where, at = vocabulary.find(h)
                term, n = np.unique(np.unique(words.doc_of_words()[where] * v + at) % max(v, 1), return_counts=True)
                total[term] += n
                texts += rows.stop - rows.start
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], texts))],
                                         names=["term", "n"])

    return count


def _bit(doc: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(1 << MAP_BITS))


def _packed(terms, ids):
    """doc, _hash and the different terms of each text whose id may be among ``ids``, as packed 32-bit numbers. ``ids`` is a
    bit map of fixed size. It is read in the task that packs, so that a task needs no second Python worker."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(terms.value)
        v = max(len(terms.value), 1)
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((ids.value[bit >> 3] >> (bit & 7) & 1).astype(bool)))
            for rows, data, offsets in tx.text_pieces(batch, "_text", PIECE):
                n = rows.stop - rows.start
                h, words = _terms(data, offsets)
                where, at = vocabulary.find(h)
                own = np.unique(words.doc_of_words()[where] * v + at)
                raw, ends = (own % v).astype("<u4"), 4 * np.searchsorted(own, np.arange(n + 1) * v)
                part = batch.slice(rows.start, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("_hash"), pa.Array.from_buffers(
                        pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])], names=["doc", "_hash", "terms"])

    return pack


def _class_frequencies(v: int):
    """label, number of the term, texts that hold it, from packed terms; term -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros((2, v), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for y in (0, 1):
                own = batch.column("terms").filter(pa.array(label == y)).to_pylist()
                total[y] += np.bincount(np.frombuffer(b"".join(own), "<u4"), minlength=v)
                texts[y] += len(own)
        for y in (0, 1):
            some = np.flatnonzero(total[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some) + 1, y), pa.int32()), pa.array(np.append(some, -1), pa.int32()),
                                              pa.array(np.append(total[y][some], texts[y]))], names=["label", "term", "n"])

    return count


class _Vectors:
    """Unit vectors over the vocabulary."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray):
        self.terms, self.weight, self._vocabulary = terms, weight.astype(np.float32), None

    def __getstate__(self):
        return {**self.__dict__, "_vocabulary": None}

    def unit(self, n: int, doc: np.ndarray, h: np.ndarray, tf: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(texts, text, term's number, weight), from the terms' hashes and occurrences."""
        if self._vocabulary is None:
            self._vocabulary = _Vocabulary(self.terms)
        where, at = self._vocabulary.find(h)
        doc, w = doc[where], (1 + np.log(tf[where])) * self.weight[at]
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n))
        some = w > 0
        doc, at, w = doc[some], at[some], w[some]
        return n, doc, at, (w / norm[doc]).astype(np.float32)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return self.unit(len(offsets) - 1, *_term_counts(data, offsets))


class _Index:
    """Block-max inverted index of the examples."""

    def __init__(self, vectors: _Vectors, sparse: tuple[int, np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, ids: np.ndarray):
        n, doc, term, w = sparse
        self.vectors, self.skipped, self.blocks_asked = vectors, 0, 0
        # Examples without a word of weight are nobody's neighbours; the others follow their heaviest word.
        by_weight = np.lexsort((term, -w, doc))
        present, first = np.unique(doc[by_weight], return_index=True)
        order = present[np.lexsort((ids[present], labels[present], term[by_weight][first]))]
        place = np.full(n, -1)
        place[order] = np.arange(len(order))
        self.labels, self.ids = labels[order], ids[order]
        m, v = len(order), len(vectors.terms)
        self.blocks = -(-m // BLOCK_ROWS)
        df = np.bincount(term, minlength=v)
        self.row = np.full(v, -1, dtype=np.int32)
        often = np.flatnonzero(df * OFTEN > m)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.blocks * BLOCK_ROWS), dtype=np.float32)
        dense = self.row[term] >= 0
        self.matrix[self.row[term[dense]], place[doc[dense]]] = w[dense]
        self.most = self.matrix.reshape(len(often), self.blocks, BLOCK_ROWS).max(axis=2) if m else np.zeros((0, 0), np.float32)
        doc, term, w = place[doc[~dense]], term[~dense], w[~dense]
        by_term = np.lexsort((doc, term))
        self.example, self.part = doc[by_term].astype(np.int32), w[by_term]
        self.start = np.searchsorted(term[by_term], np.arange(v + 1))

    @property
    def weights(self) -> np.ndarray:
        """All weights as one matrix, terms by examples."""
        full = np.zeros((len(self.row), len(self.ids)), dtype=np.float32)
        full[self.row >= 0] = self.matrix[:, :len(self.ids)]
        full[np.repeat(np.arange(len(self.row)), np.diff(self.start)), self.example] = self.part
        return full

    def _short_lists(self, n: int, doc: np.ndarray, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What words that are not frequent give to each cosine."""
        m = self.matrix.shape[1]
        out = np.zeros((n, m), dtype=np.float32)
        long = self.start[term + 1] - self.start[term]
        # Lists are joined in stretches of about CELLS pairs.
        cuts = np.searchsorted(np.cumsum(long), np.arange(CELLS, int(long.sum()) + CELLS, CELLS), side="left") + 1
        lo = 0
        for hi in np.minimum(cuts, len(term)):
            size = long[lo:hi]
            at = np.arange(int(size.sum())) + np.repeat(self.start[term[lo:hi]] - np.cumsum(size) + size, size)
            cell = np.repeat(doc[lo:hi], size) * m + self.example[at]
            out += np.bincount(cell, weights=np.repeat(w[lo:hi], size) * self.part[at], minlength=n * m).reshape(n, m).astype(np.float32)
            lo = hi
        return out

    def _cosines(self, n: int, doc: np.ndarray, term: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
        """Cosines, queries by examples. Those of skipped blocks are too small; none of them is among the k largest."""
        dense = self.row[term] >= 0
        q = np.zeros((n, len(self.matrix)), dtype=np.float32)
        q[doc[dense], self.row[term[dense]]] = w[dense]
        found = self._short_lists(n, doc[~dense], term[~dense], w[~dense])
        bound = found.reshape(n, self.blocks, BLOCK_ROWS).max(axis=2) + q @ self.most + SLACK
        seen = np.zeros((n, self.blocks), dtype=bool)
        best = np.argpartition(-bound, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS]
        first = np.zeros_like(seen)
        np.put_along_axis(first, best, True, axis=1)
        # All weights are positive, so what has been added up so far never exceeds the cosine.
        for ask in (lambda: first, lambda: ~seen):
            least = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]
            open_ = ask() & (bound >= least[:, None])
            for b in np.flatnonzero(open_.any(axis=0)):
                rows = np.flatnonzero(open_[:, b])
                own = slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS)
                found[rows, own] += q[rows] @ self.matrix[:, own]
            seen |= open_
        self.blocks_asked += seen.size
        self.skipped += int(seen.size - seen.sum())
        return found

    def nearest(self, q, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, example) of the k nearest examples of each query, exact; cosine 0 where there are fewer. Queries are
        (number, query, term's number, weight) in the order of the queries, or a matrix. Of equal cosines the first examples
        in the order of the index count."""
        if isinstance(q, np.ndarray):
            q = (len(q), *np.nonzero(q), q[np.nonzero(q)])
        n, doc, term, w = q
        m = self.matrix.shape[1]
        score, which = np.zeros((n, k), dtype=np.float32), np.full((n, k), -1)
        step = max(CELLS // max(m, 1), 1)
        for lo in range(0, n if m else 0, step):
            hi = min(lo + step, n)
            own = slice(*np.searchsorted(doc, [lo, hi]))
            few = min(k, m)
            found = self._cosines(hi - lo, doc[own] - lo, term[own], w[own], few)
            best = np.sort(np.argpartition(-found, few - 1, axis=1)[:, :few], axis=1)
            least = np.take_along_axis(found, best, 1).min(axis=1)
            tied = np.flatnonzero((least > 0) & ((found >= least[:, None]).sum(axis=1) > few))
            if len(tied):
                best[tied] = np.sort(np.argsort(-found[tied], axis=1, kind="stable")[:, :few], axis=1)
            value = np.take_along_axis(found, best, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            value = np.take_along_axis(value, order, 1)
            score[lo:hi, :few] = value
            which[lo:hi, :few] = np.where(value > 0, np.take_along_axis(best, order, 1), -1)
        return score, which

    def votes(self, q, base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(share of toxic votes, weight of all votes, cosines, examples)."""
        score, which = self.nearest(q, NEIGHBOURS)
        toxic = np.where(which >= 0, np.append(self.labels, 0)[which], 0) * score
        weight = score.sum(axis=1)
        return (toxic.sum(axis=1) + PRIOR * base) / (weight + PRIOR), weight, score, which


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic fit, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    logit = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    return np.column_stack([np.ones(len(share)), logit * np.sqrt(weight / NEIGHBOURS)])


def _calibrated(share: np.ndarray, weight: np.ndarray, fit: np.ndarray, base: float) -> np.ndarray:
    """Scores; a text that no example shares a word of weight with has the base rate."""
    return np.where(weight > 0, 1 / (1 + np.exp(-np.clip(_features(share, weight) @ fit, -30, 30))), base)


class LearningRows(NamedTuple):
    """``texts``: doc, _hash, _text of all texts. ``known``: doc, _hash, label, size and
    held (in the calibration fold) of those that are, each text once."""

    texts: DataFrame
    known: DataFrame


def learning_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> LearningRows:
    """The labelled texts whose fold is not held out. Of several labels of an id the largest counts. Equal texts are one
    example: the smallest id, with the label that most of them have (toxic, if as many). Texts are not shuffled for this."""
    known = (labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc")).agg(F.max(label).cast("int").alias("label"))
             .filter(tx.fold_of("doc", 4) != 2))
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("_text"))
    texts = texts.withColumn("_hash", F.unhex(F.md5(F.coalesce("_text", F.lit("")).cast("binary"))))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).alias("size")
    # A map of fixed size keeps most ids without a label out.
    once = only_ids(texts.select("doc", "_hash", size), known).join(known, "doc").groupBy("_hash").agg(
        F.min("doc").alias("doc"), F.when(F.avg("label") >= 0.5, 1).otherwise(0).alias("label"), F.max("size").alias("size"))
    return LearningRows(texts, once.withColumn("held", F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(CALIBRATION_SHARE)) == 0))


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G of the table of texts with the word in either class (a of n1, b of n0) against texts without it."""
    def part(x, expected):
        return x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, expected, 1))

    n, has = max(n1 + n0, 1), (a + b).astype(np.float64)
    g = 2 * (part(a, has * (n1 / n)) + part(b, has * (n0 / n)) + part(n1 - a, (n - has) * (n1 / n)) + part(n0 - b, (n - has) * (n0 / n)))
    return np.maximum(g, 0)


def _rated(index: _Index, base: float, fit: np.ndarray | None, data: np.ndarray, offsets: np.ndarray):
    """(scores, cosines, examples) of the texts of a run of bytes."""
    share, weight, cosines, which = index.votes(index.vectors.of(data, offsets), base)
    return share if fit is None else _calibrated(share, weight, fit, base), cosines, which


class ToxicityModel:
    """Learned index and calibration, on the driver."""

    def __init__(self, learn: LearningRows, examples: int = EXAMPLES, docs: DataFrame | None = None, text: str = "text",
                 example_bytes: int = EXAMPLE_BYTES):
        """``learn``: see ``learning_rows``. ``docs``: all documents, whose texts give the document frequencies; without
        them the learning texts outside the calibration fold do."""
        spark = learn.known.sparkSession
        known = materialize(learn.known)
        ids, y, held, size, h, tf = self._examples(learn.texts, known, examples, example_bytes)
        tx.release()
        terms = np.unique(h)
        shared = spark.sparkContext.broadcast(terms)
        bits = known.filter("not held").select(F.shiftright(_bit("doc"), 3).alias("byte"), F.expr("shiftleft(1, cast(xxhash64(doc) & 7 as int))").alias("b"))
        found = bits.groupBy("byte").agg(F.bit_or("b").alias("b")).toArrow()
        ids_map = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
        ids_map[found.column("byte").to_numpy()] = found.column("b").to_numpy()
        packed = learn.texts.select("doc", "_hash", "_text", F.coalesce(_bit("doc"), F.lit(0)).alias("bit")).mapInArrow(
            tx.tidy(_packed(shared, spark.sparkContext.broadcast(ids_map))), f"doc {dict(known.dtypes)['doc']}, _hash binary, terms binary")
        own = packed.join(known.filter("not held").select("doc", "_hash", "label"), ["doc", "_hash"]).dropDuplicates(["doc", "_hash"])
        counts = (own.select("label", "terms").mapInArrow(tx.tidy(_class_frequencies(len(terms))), "label int, term int, n bigint")
                  .groupBy("label", "term").agg(F.sum("n").alias("n")).toArrow())
        by_class = np.zeros((2, len(terms) + 1), dtype=np.int64)
        by_class[counts.column("label").to_numpy(), counts.column("term").to_numpy()] = counts.column("n").to_numpy()
        (b, a), (n0, n1) = by_class[:, :-1], by_class[:, -1].tolist()
        total, df = n0 + n1, a + b
        if docs is not None:
            found = (docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(tx.tidy(_frequencies(shared)), "term int, n bigint")
                     .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
            df = np.zeros(len(terms) + 1, dtype=np.int64)
            df[found.column("term").to_numpy()] = found.column("n").to_numpy()
            total, df = int(df[-1]), df[:-1]
        self.base = n1 / (n0 + n1 + 1) if n0 and n1 else 0.0
        # Without both classes no word has a weight, so no text has neighbours.
        idf, ratio = (np.log((total + 1) / (df + 1)) + 1) * bool(n0 and n1), _likelihood_ratio(a, b, n1, n0)
        # Only the best index so far is kept.
        self.losses, self.index = [], None
        for power in POWERS:
            loss, index, fit = self._fitted(_Vectors(terms, idf * ratio ** power), y, ids, held, size, h, tf)
            if self.index is None or loss < min(self.losses):
                self.power, self.index, self.fit = power, index, fit
            self.losses.append(loss)
            del index
            tx.release()
        del size, h, tf
        tx.release()
        self.shared = spark.sparkContext.broadcast((self.index, self.base, self.fit))

    @staticmethod
    def _examples(texts: DataFrame, known: DataFrame, examples: int, example_bytes: int):
        """Ids, labels, calibration flags, numbers of terms, and all terms and occurrences of the examples."""
        order = F.xxhash64("doc", F.lit(3))
        rows = [r for y in (0, 1) for r in known.filter(F.col("label") == y).orderBy(order, "doc", "_hash").limit(examples).collect()]
        chosen, left = [], [example_bytes] * 2
        for r in rows:
            if r["size"] <= left[r.label]:
                left[r.label] -= r["size"]
                chosen.append((len(chosen), r.doc, bytes(r["_hash"]), r.label, r.held))
        kind = dict(known.dtypes)["doc"]
        few = texts.sparkSession.createDataFrame(chosen, f"place int, doc {kind}, _hash binary, label int, held boolean")

        def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offsets in tx.text_pieces(batch, "_text", PIECE):
                    n = rows.stop - rows.start
                    doc, h, tf = _term_counts(data, offsets)
                    ends = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("place").slice(rows.start, n), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))),
                         pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["place", "terms", "tf"])

        # At most ``examples`` rows of ids a class are broadcast; a repeated row is the same example again.
        found = (texts.join(F.broadcast(few.select("place", "doc", "_hash")), ["doc", "_hash"]).select("place", "_text")
                 .mapInArrow(tx.tidy(terms_of), "place int, terms array<bigint>, tf array<int>").toArrow().combine_chunks())
        places, at = np.unique(found.column("place").to_numpy(), return_index=True)
        found = found.take(pa.array(at)).combine_chunks()
        lists = found.column("terms").combine_chunks() if len(places) else pa.array([], pa.list_(pa.int64()))
        tf = found.column("tf").combine_chunks().flatten().to_numpy() if len(places) else np.empty(0, np.int32)
        ids = np.array([chosen[p][1] for p in places], dtype=np.int64)
        y, held = np.array([chosen[p][3] for p in places], dtype=np.int64), np.array([chosen[p][4] for p in places], dtype=bool)
        return ids, y, held, lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy().view(np.uint64), tf

    def _fitted(self, vectors: _Vectors, y, ids, held, size, h, tf) -> tuple[float, _Index, np.ndarray | None]:
        """(log loss on the calibration fold, index of the other examples, calibration). Both classes are sampled; weights
        bring the calibration back to their shares among all labelled rows."""
        def part(own):
            inside = np.repeat(own, size)
            return vectors.unit(int(own.sum()), np.repeat(np.arange(own.sum()), size[own]), h[inside], tf[inside])

        index = _Index(vectors, part(~held), y[~held], ids[~held])
        if len(set(y[held].tolist())) < 2 or not 0 < self.base < 1:
            return 0.0, index, None
        share, weight, _, _ = index.votes(part(held), self.base)
        voted, drawn = weight > 0, y[held].mean()
        fit = _logistic(_features(share[voted], weight[voted]), y[held][voted])
        p = np.clip(_calibrated(share, weight, fit, drawn), 1e-9, 1 - 1e-9)
        loss = -float(np.mean(np.where(y[held] == 1, np.log(p), np.log(1 - p))))
        fit[0] += np.log(self.base / (1 - self.base)) - np.log(drawn / (1 - drawn))
        return loss, index, fit

    def rating(self, text: str = "text") -> Column:
        """The score alone, as a column: texts and whatever else rows hold stay in the JVM."""
        shared = self.shared

        @F.arrow_udf("double")
        def rate(texts: pa.Array) -> pa.Array:
            index, base, fit = shared.value
            batch = pa.RecordBatch.from_arrays([texts], names=["_text"])
            scores = [_rated(index, base, fit, data, offsets)[0] for _, data, offsets in tx.text_pieces(batch, "_text", PIECE)]
            tx.release()
            return pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())

        return rate(F.col(text).cast("string"))

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3,
              carry: tuple[str, ...] = ()) -> DataFrame:
        """One row per row of ``docs``: id, columns of ``carry``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold``)
        and ``evidence``: ids, labels and cosines of up to three nearest examples.

        Null, empty and wordless texts, and others without evidence, get the share of toxic learning texts; without labels of
        both classes that is 0. Repeated rows each get their row."""
        shared = self.shared
        # A text that is carried goes to the tasks once.
        carried = text in carry and dict(docs.dtypes)[text] == "string"
        source = docs.select(F.struct(F.col(doc_id), *carry).alias("_row"), *([] if carried else [F.col(text).cast("string").alias("_text")]))
        names = [f.name for f in source.schema["_row"].dataType.fields]
        kinds = [f.dataType.simpleString() for f in source.schema["_row"].dataType.fields]
        near = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, base, fit = shared.value
            for batch in batches:
                if carried:
                    batch = batch.append_column("_text", batch.column("_row").field(names.index(text)))
                for rows, data, offsets in tx.text_pieces(batch, "_text", PIECE):
                    p, cosines, which = _rated(index, base, fit, data, offsets)
                    row = batch.column("_row").slice(rows.start, len(p))
                    evidence = [[{"id": int(index.ids[j]), "label": int(index.labels[j]), "cosine": float(c)}
                                 for c, j in zip(cs[:3], js[:3], strict=True) if c > 0] for cs, js in zip(cosines, which, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [row.field(i) for i in range(len(names))] + [pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                                                                     pa.array(evidence, near)],
                        names=[*names, "score", "predicted", "evidence"])

        schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
        return source.mapInArrow(tx.tidy(rate), f"{schema}, score double, predicted int, "
                                       "evidence array<struct<id:bigint,label:int,cosine:double>>")
