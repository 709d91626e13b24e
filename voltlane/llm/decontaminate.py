"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive words, the smallest of its k-gram hashes is kept as a fingerprint. Two equal windows
keep the same one, so every shared span of ``WINDOW`` words or more shares a fingerprint: only document positions whose
fingerprint is also one of the benchmark are looked at, and there the windows around it are compared as a whole.
Items shorter than a window have no such guarantee; they are compared whole, by their length.

The benchmark is read in blocks of at most ``block_bytes`` of text, and one block at a time is sent to the tasks that
scan the documents, so what is sent does not grow with either table. A larger benchmark takes more passes; between
passes, documents with their hits so far are written to the shared folder. Documents are never shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize
from . import text as tx

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
STATE = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def fingerprints(h: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Positions of the k-grams that winnowing keeps. ``fits[i]``: a window that starts at word i ends in its text."""
    grams = tx.windows(h, GRAM)
    n = len(fits)
    least, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for k in range(1, WINDOW - GRAM + 1):
        other = grams[k:k + n]
        less = other <= least
        least[less] = other[less]
        at[less] = k
    keep = np.zeros(len(grams), dtype=bool)
    keep[(np.arange(n) + at)[fits]] = True
    return np.flatnonzero(keep)


def _fits(words: tx.Words, size: int) -> np.ndarray:
    """For every start of a window of ``size`` words: is it within one text?"""
    n = len(words.starts) - size + 1
    if n <= 0:
        return np.empty(0, dtype=bool)
    doc = words.doc_of_words()
    return doc[:n] == doc[size - 1:]


def _lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class _Index:
    """Windows, fingerprints and whole short items of one block of the benchmark."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("_item").combine_chunks()
        owner, hashes, size, prints = [], [], [], []
        base = 0
        for batch in table.to_batches():
            for rows, data, offsets in tx.text_pieces(batch, "_text"):
                words = tx.split_words(data, offsets, tx.MARKS, tx.LOWER)
                h, counts = words.hashes(), words.counts()
                item = base + rows.start + words.doc_of_words()
                fits = _fits(words, WINDOW)
                if len(fits):
                    hashes.append(tx.windows(h, WINDOW)[fits])
                    owner.append(item[:len(fits)][fits])
                    size.append(np.full(int(fits.sum()), WINDOW))
                    prints.append(tx.windows(h, GRAM)[fingerprints(h, fits)])
                for short in range(1, WINDOW):
                    own = np.flatnonzero(counts == short)
                    if len(own):
                        hashes.append(tx.windows(h, short)[words.first[own]])
                        owner.append(base + rows.start + own)
                        size.append(np.full(len(own), short))
            base += batch.num_rows
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
        owner, hashes, size = join(owner, np.int64), join(hashes, np.uint64), join(size, np.int64)
        self.by_size = {}
        for s in np.unique(size):
            own, key = owner[size == s], hashes[size == s]
            order = np.lexsort((own, key))
            keys, first = np.unique(key[order], return_index=True)
            self.by_size[int(s)] = (keys, np.append(first, len(order)), own[order])
        self.prints = np.unique(join(prints, np.uint64))
        # One bit of 2**22 per fingerprint: nearly all k-grams of the documents end here.
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[self.prints >> np.uint64(42)] = True

    def starts(self, words: tx.Words, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window size, starts of windows of the benchmark, their rows in the index)."""
        for s, (keys, _, _) in self.by_size.items():
            fits = _fits(words, s)
            if not len(fits):
                continue
            if s == WINDOW:
                at = fingerprints(h, fits)
                grams = tx.windows(h, GRAM)[at]
                maybe = self.sieve[grams >> np.uint64(42)]
                at = at[maybe][_lookup(self.prints, grams[maybe]) >= 0]
                # Extend: a window that holds the k-gram starts at most WINDOW - GRAM words before it.
                near = np.zeros(len(fits), dtype=bool)
                for k in range(WINDOW - GRAM + 1):
                    start = at - k
                    near[start[(start >= 0) & (start < len(fits))]] = True
                starts = np.flatnonzero(near & fits)
                if not len(starts):
                    continue
            else:
                starts = np.flatnonzero(fits)
            row = _lookup(keys, tx.windows(h, s)[starts])
            yield s, starts[row >= 0], row[row >= 0]


def _scan(index: _Index, first: bool, last: bool):
    """A task's pass over its documents for one block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tx.text_pieces(batch, "_text"):
                words = tx.split_words(data, offsets, tx.MARKS, tx.LOWER)
                h, n = words.hashes(), rows.stop - rows.start
                mark = np.zeros(len(words.starts) + 1, dtype=np.int32)
                pairs = [np.empty((0, 2), dtype=np.int64)]
                doc = words.doc_of_words()
                for s, starts, row in index.starts(words, h):
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + s, -1)
                    _, begin, own = index.by_size[s]
                    count = begin[row + 1] - begin[row]
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    pairs.append(np.unique(np.column_stack(
                        [np.repeat(doc[starts], count), own[np.repeat(begin[row], count) + step]]), axis=0))
                hit = np.cumsum(mark[:-1]) > 0
                # Runs of hit words, cut where a text ends.
                begins = hit.copy()
                begins[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
                stops = hit.copy()
                stops[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
                b, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                pairs = np.unique(np.concatenate(pairs), axis=0)
                span_at = np.searchsorted(doc[b], np.arange(n + 1)).astype(np.int32)
                item_at = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(b - words.first[doc[b]], pa.int64()), pa.array(e - words.first[doc[b]], pa.int64())],
                    names=["start", "stop"])
                part = batch.slice(rows.start, n)
                out = {"n_words": pa.array(words.counts(), pa.int64()), "spans": pa.ListArray.from_arrays(span_at, spans),
                       "items": pa.ListArray.from_arrays(item_at, index.ids.take(pa.array(pairs[:, 1])).cast(pa.string()))}
                if not first:
                    for name in ("spans", "items"):
                        both = [x + y for x, y in zip(part.column(name).to_pylist(), out[name].to_pylist(), strict=True)]
                        out[name] = pa.array(both, out[name].type)
                keep = [c for c in part.schema.names if c not in out and not (last and c == "_text")]
                if not last:
                    keep = [c for c in keep if c != "_text"] + ["_text"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + list(out.values()), names=keep + list(out))

    return scan


def _united(spans):
    """Spans of all passes as disjoint ones: sorted, then joined where they touch."""
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,stop:bigint>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(s))))


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, a struct ``row`` of the columns of ``carry`` (if any), ``n_words``, ``spans`` (disjoint word ranges [start, stop) inside windows of the
    benchmark) and ``items`` (sorted ids, as text, of the items that occur; each id once).

    Null or empty texts have no words and no hits. An item without words hits nothing. An item without id marks words but
    is not listed. Repeated documents each get their row; repeated items count once. An empty benchmark gives no hits.
    Other columns of either table are not used."""
    items = bench.select(F.col(item_id).cast("string").alias("_item"), F.col(item_text).alias("_text"))
    items = items.filter(F.octet_length("_text") > 0)
    total = items.agg(F.sum(F.octet_length("_text"))).head()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    state = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text"),
                        *([F.struct(*carry).alias("_row")] if carry else []))
    own_columns = ", ".join(f"{c} {k}" for c, k in state.dtypes if c != "_text")
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("_text", "_item"), F.lit(blocks)) == b) if blocks > 1 else items
        first, last = b == 0, b == blocks - 1
        scan = _scan(_Index(own.toArrow()), first, last)
        state = state.mapInArrow(tx.tidy(scan), f"{own_columns}{'' if last else ', _text string'}, {STATE}")
        if not last:
            state = materialize(state)
    named = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    spans = F.col("spans") if blocks == 1 else _united(F.col("spans"))
    return state.select(F.col("_doc").alias(doc_id), *([F.col("_row").alias("row")] if carry else []), "n_words", spans.alias("spans"), named.alias("items"))
