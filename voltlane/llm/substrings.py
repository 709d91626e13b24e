"""Substring dedup by difference-cover anchors.

Positions of a text are taken modulo ``PERIOD``; a difference cover holds a few residues such that every difference of
two positions is a difference of two of them. So wherever two texts share ``WINDOW`` words, some offset below ``PERIOD``
puts both on cover positions, and the ``ANCHOR`` words from there lie inside the shared part. Hashing only at cover
positions (4 of 13) finds every long match.

0. A document whose whole text has a smaller id elsewhere is a repeat as a whole.
1. Anchors of all other documents, grouped by hash: those seen twice or more are repeated.
2. Extension: only windows around a repeated anchor are hashed as a whole (128 bits) and grouped; in each group every
   window but the first (by document id, then start) is a repeat.
3. Words inside repeats are cut from their documents.

No pairs are formed: groups are reduced to their first member. Tasks send packed arrays, not rows, and reduce before
sending: of a window or anchor that a task meets many times it sends one, so a passage that a third of all documents
hold arrives once per task. What a task packs and what it unpacks at a time is bounded by ``FLUSH`` and the number of
routes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a task gathers before it sends them.
FLUSH = 1 << 20
#: The place of an entry in its document: word position below, 16 bits of the text's hash above.
TAG_SHIFT = np.uint64(40)
POSITION = np.uint64((1 << 40) - 1)
PACKED = "route int, many boolean, n int, data binary"
PLACES = "doc bigint, places binary"


def _pack(route: np.ndarray, columns: list[np.ndarray], many: bool) -> Iterator[tuple]:
    """One row per route with its entries, in their order."""
    order = np.argsort(route, kind="stable")
    route = route[order]
    cuts = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]])) if len(route) else []
    columns = [c[order] for c in columns]
    for lo, hi in zip(cuts, [*cuts[1:], len(route)], strict=True) if len(route) else ():
        yield int(route[lo]), many, int(hi - lo), b"".join(tx.planes(c[lo:hi]) for c in columns)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                      names=["route", "many", "n", "data"])


def _spread(doc: np.ndarray, routes: int) -> np.ndarray:
    return (tx.mix(doc.astype(np.uint64)) % np.uint64(routes)).astype(np.int32)


def _place_rows(doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document with its places."""
    if not len(doc):
        return
    order = np.lexsort((place, doc))
    doc, place = doc[order], np.ascontiguousarray(place[order])
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    at = np.append(cuts, len(doc)).astype(np.int32) * 8
    packed = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(at), pa.py_buffer(place)])
    yield pa.RecordBatch.from_arrays([pa.array(doc[cuts], pa.int64()), packed], names=["doc", "places"])


def _send_anchors(routes: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, at = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            _, first, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            many = times[which] > 1
            # Of a hash met several times here, one entry goes out for others to meet; all its places are repeated.
            once = np.zeros(len(key), dtype=bool)
            once[first] = True
            route = (key >> np.uint64(48)) % np.uint64(routes)
            yield _rows([*_pack(route[once], [key[once], doc[once], at[once]], False),
                         *_pack(_spread(doc[many], routes), [doc[many], at[many]], True)])

        for batch in batches:
            for rows, data, offsets in tx.text_pieces(batch, "_text"):
                words = tx.split_words(data, offsets)
                h, owner = tx.windows(words.hashes(), ANCHOR), words.doc_of_words()
                n = len(h)
                local = np.arange(n) - words.first[owner[:n]]
                cover = np.zeros(PERIOD, dtype=bool)
                cover[list(COVER)] = True
                at = np.flatnonzero((owner[:n] == owner[ANCHOR - 1:]) & cover[local % PERIOD]) if n else np.empty(0, int)
                ids = batch.column("_doc").slice(rows.start, rows.stop - rows.start).to_numpy(zero_copy_only=False)
                held.append((h[at], ids[owner[at]].astype(np.int64), local[at].astype(np.uint64)))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        if held and sum(len(x[0]) for x in held):
            yield from flush()

    return send


def _by_route(batches: Iterator[pa.RecordBatch], kinds: list, settle) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unpack the rows of one route at a time (they come sorted by route) and give out the (documents, places) that
    ``settle`` finds, with those that were known where they came from."""
    held: list[list[np.ndarray]] = []
    known: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts = list(known)
        if held:
            parts.append(settle(*(np.concatenate(c) for c in zip(*held, strict=True))))
        held.clear()
        known.clear()
        if parts:
            yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    for batch in batches:
        for route, many, n, data in zip(*(batch.column(c).to_pylist() for c in ("route", "many", "n", "data")), strict=True):
            if route != now:
                yield from flush()
                now = route
            columns, at = [], 0
            for kind in ([np.int64, np.uint64] if many else kinds):
                columns.append(tx.from_planes(data[at:at + 8 * n], kind, n))
                at += 8 * n
            if many:
                known.append((columns[0], columns[1]))
            else:
                held.append(columns)
    yield from flush()


def _packed_places(found: Iterator[tuple[np.ndarray, np.ndarray]], routes: int) -> Iterator[pa.RecordBatch]:
    """Send places to their documents: packed, one row per route and FLUSH places."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        doc, place = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((place, doc))
        if len(doc):
            yield _rows([*_pack(_spread(doc[order], routes), [doc[order], place[order]], True)])

    for x in found:
        held.append(x)
        if sum(len(d) for d, _ in held) >= FLUSH:
            yield from flush()
    if held:
        yield from flush()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with all its places."""
    for doc, place in _by_route(batches, [], None):
        yield from _place_rows(doc, place)


def _repeated_anchors(batches: Iterator[pa.RecordBatch], routes: int) -> Iterator[pa.RecordBatch]:
    def settle(key, doc, at):
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        own = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return doc[own], at[own]

    yield from _packed_places(_by_route(batches, [np.uint64, np.int64, np.uint64], settle), routes)


def _firsts(h1, h2, doc, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by window, document, start; for each entry in it: is it later than the first of its window? Is it the same
    as the entry before?"""
    start = at & POSITION
    order = np.lexsort((at, start, doc, h2, h1))
    h1, h2, doc, at, start = h1[order], h2[order], doc[order], at[order], start[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[lead]) | (start != start[lead])
    twin = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
    return order, later, twin


def _send_windows(routes: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            order, later, twin = _firsts(*columns)
            # Sent in the order of the texts, where ids and places of neighbours are alike and compress.
            out, own = np.sort(order[~later & ~twin]), np.sort(order[later & ~twin])
            h1, h2, doc, at = columns
            route = (h1 >> np.uint64(48)) % np.uint64(routes)
            yield _rows([*_pack(route[out], [h1[out], h2[out], doc[out], at[out]], False),
                         *_pack(_spread(doc[own], routes), [doc[own], at[own]], True)])

        for batch in batches:
            for rows, data, offsets in tx.text_pieces(batch, "_text"):
                words = tx.split_words(data, offsets)
                h, owner, counts = words.hashes(), words.doc_of_words(), words.counts()
                ids, tags, places = ([x[rows] for x in (batch.column("doc").to_numpy(), batch.column("_tag").to_numpy())]
                                     + [batch.column("places").slice(rows.start, rows.stop - rows.start).to_pylist()])
                near = np.zeros(len(h) + 1, dtype=np.int32)
                for d, packed in enumerate(places):
                    anchors = np.unique(np.frombuffer(packed, np.uint64).astype(np.int64))
                    # A window that holds the anchor starts at most PERIOD - 1 words before it.
                    last = counts[d] - WINDOW
                    lo, hi = np.maximum(anchors - PERIOD + 1, 0), np.minimum(anchors, last)
                    ok = lo <= hi
                    np.add.at(near, words.first[d] + lo[ok], 1)
                    np.add.at(near, words.first[d] + hi[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                if len(at):
                    own = owner[at]
                    place = (at - words.first[own]).astype(np.uint64) | (tags[own].astype(np.uint64) << TAG_SHIFT)
                    held.append((tx.windows(h, WINDOW)[at], tx.windows(words.hashes(1), WINDOW, 1)[at], ids[own], place))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return send


def _repeated_windows(batches: Iterator[pa.RecordBatch], routes: int) -> Iterator[pa.RecordBatch]:
    def settle(h1, h2, doc, at):
        order, later, _ = _firsts(h1, h2, doc, at)
        own = order[later]
        return doc[own], at[own]

    yield from _packed_places(_by_route(batches, [np.uint64, np.uint64, np.int64, np.uint64], settle), routes)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in tx.text_pieces(batch, "_text"):
            n = rows.stop - rows.start
            part = batch.slice(rows.start, n)
            words = tx.split_words(data, offsets)
            mark = np.zeros(len(words.starts), dtype=bool)
            lists = part.column("places").to_pylist()
            tags = part.column("_tag").to_numpy(zero_copy_only=False)
            touched = [d for d in range(n) if lists[d]]
            for d in touched:
                place = np.frombuffer(lists[d], np.uint64)
                mine = place[(place >> TAG_SHIFT) == np.uint64(tags[d])] & POSITION
                mark[words.first[d] + mine.astype(np.int64)] = True
            gone, owner = tx.in_windows(mark, WINDOW), words.doc_of_words()
            counts = words.counts()
            for d in np.flatnonzero(part.column("_whole").to_numpy(zero_copy_only=False) & (counts >= WINDOW)).tolist():
                gone[words.first[d]:words.first[d + 1]] = True
                touched.append(d)
            edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, bool)
            before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
            ends = np.concatenate([edge[1:], [True]]) if len(gone) else edge
            b, e = np.flatnonzero(gone & (edge | ~before)), np.flatnonzero(gone & (ends | ~after)) + 1
            span_at = np.searchsorted(owner[b], np.arange(n + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(b - words.first[owner[b]], pa.int64()),
                                                pa.array(e - words.first[owner[b]], pa.int64())], names=["start", "stop"])
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            texts = part.column("_text")
            if len(b):
                texts = texts.to_pylist()
                for d in touched:
                    lo, hi = span_at[d], span_at[d + 1]
                    if lo < hi:
                        # A cut runs to the next word, so the blank before it still parts what is left.
                        limit = int(words.offsets[d + 1])
                        pieces, at = [], int(words.offsets[d])
                        for x, y in zip(b[lo:hi], e[lo:hi], strict=True):
                            pieces.append(words.data[at:words.starts[x]])
                            at = int(words.starts[y]) if y < words.first[d + 1] else limit
                        pieces.append(words.data[at:limit])
                        texts[d] = b"".join(p.tobytes() for p in pieces).decode()
                texts = pa.array(texts, part.column("_text").type)
            yield pa.RecordBatch.from_arrays(
                [part.column("_row").field(i) for i in range(part.column("_row").type.num_fields)]
                + [pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()),
                   pa.ListArray.from_arrays(span_at, spans), texts],
                names=[f.name for f in part.column("_row").type] + ["n_words", "n_removed", "removed", "kept_text"])


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, columns of ``carry``, ``n_words``, ``n_removed``, ``removed`` (word ranges
    [start, stop)) and ``kept_text`` (the text without them, blanks as they were; the text itself where nothing goes).

    A word goes if a window of WINDOW words over it also starts earlier: at a smaller integer id, or before it in the same
    text. Windows are judged on the input. Null or short texts have no windows. Rows without id keep their text and are no
    source for others. Repeated rows are one document; texts that share an id are not earlier than each other at the same
    start. Columns that are not named may be called anything."""
    routes = tx.parallelism(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("_text"),
                       F.struct(F.col(doc_id), *carry).alias("_row"))
    known = rows.filter("doc is not null")
    hashed = known.select("doc", F.md5(F.coalesce("_text", F.lit("")).cast("binary")).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first <> last")
    copies = hashed.join(first, "hash").filter("doc <> first").select("doc", "hash").distinct()

    def joined(places: DataFrame) -> DataFrame:
        """Texts with their places. All joins send the same columns of the same rows by the same key (``_row`` too, though
        only the last one uses it), so that Spark sends the texts once and reads them again."""
        return known.join(places, "doc", "left").withColumn("_tag", F.coalesce(F.xxhash64("_text").bitwiseAND(F.lit(0xFFFF)), F.lit(0)))

    def by_route(packed: DataFrame) -> DataFrame:
        return packed.repartition("route").sortWithinPartitions("route")

    def gathered(packed: DataFrame) -> DataFrame:
        return by_route(packed).mapInArrow(tx.tidy(_gather), PLACES)

    # A copy of a text with a smaller id repeats it whole and is no first place of any window: it need not be looked at.
    copied = copies.groupBy("doc").agg(F.collect_list("hash").alias("copied"))
    not_copied = ~F.coalesce(F.array_contains("copied", F.md5(F.coalesce("_text", F.lit("")).cast("binary"))), F.lit(False))
    anchors = joined(copied).filter(not_copied).select(F.col("doc").alias("_doc"), "_text", "_row").mapInArrow(tx.tidy(_send_anchors(routes)), PACKED)
    anchors = by_route(anchors).mapInArrow(tx.tidy(lambda it: _repeated_anchors(it, routes)), PACKED)
    near = gathered(anchors).join(copied, "doc", "full")
    found = (joined(near).filter(not_copied & F.col("places").isNotNull()).select("doc", "_text", "_row", "_tag", "places")
             .mapInArrow(tx.tidy(_send_windows(routes)), PACKED))
    found = by_route(found).mapInArrow(tx.tidy(lambda it: _repeated_windows(it, routes)), PACKED)
    last = joined(gathered(found).join(copied, "doc", "full")).withColumn("_whole", ~not_copied)
    last = last.select("_text", "_row", "_tag", "places", "_whole").unionByName(rows.filter("doc is null").select(
        "_text", "_row", F.lit(0).cast("bigint").alias("_tag"), F.lit(None).cast("binary").alias("places"), F.lit(False).alias("_whole")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema["_row"].dataType.fields)
    return last.mapInArrow(
        tx.tidy(_cut), f"{schema}, n_words bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept_text string")
