"""Collocations: phrases whose words stand together far more often than their parts would by chance.

Counts come from suffix trees cut off at the longest phrase, built by vertical partitioning. Word prefixes whose suffixes
would not fit a memory budget are extended by a word, level by level, until each prefix fits (or has full depth); prefixes
are dealt into groups of about one budget. Each group sorts its own suffixes, forms the nodes of its subtrees and reads a
node's count from the total of the leaves under it. Words, and pairs of neighbours, below the least count cannot be part
of a phrase, so they end a suffix. Bit maps of fixed size tell most of them apart while texts are read: one of the words'
hashes, one of buckets that pairs are counted in. What the maps let through is counted too and falls at the end.

A word is a 64-bit hash of the word and its language, so suffixes of different languages never meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import materialize
from . import text as tx

U64 = np.uint64
LONGEST = 5
#: Suffixes that a group should hold, and the most prefixes that a level may extend: with more text the budget grows.
BUDGET, MOST_PREFIXES = 1 << 19, 100_000
#: Suffixes in one row on their way to their group: small rows keep the batches that Python gets small.
ROW_SUFFIXES = 64
#: The map of frequent words has 2**MAP_BITS bits, that of frequent pairs 2**PAIR_BITS, in ranges of 2**RANGE_BITS.
MAP_BITS, PAIR_BITS, RANGE_BITS = 26, 28, 20
#: Buckets of pairs in one row.
ROW_PAIRS = 512
#: Bytes that end a piece and bytes that end a word; letters A-Z are lower-cased.
PIECE_ENDS = np.zeros(256, dtype=bool)
PIECE_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
WORD_ENDS = PIECE_ENDS.copy()
WORD_ENDS[[0x20, 0x09]] = True
NO_LANG = "und"


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    """A 64-bit seed per row from its language."""
    column = batch.column("_lang").dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(x or NO_LANG, seed=17) for x in column.dictionary.to_pylist()] or [0], dtype=U64)
    return seeds[column.indices.to_numpy(zero_copy_only=False).astype(np.int64)]


def _read(batch: pa.RecordBatch) -> Iterator[tuple[tx.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Words, their hashes, the row of each word, and whether a word ends its piece; in runs of rows."""
    seeds = _languages(batch)
    for rows, data, offsets in tx.text_pieces(batch, "_text"):
        words = tx.split_words(data, offsets, WORD_ENDS, tx.LOWER)
        if not len(words.starts):
            continue
        doc = words.doc_of_words()
        h = tx.mix(words.hashes() ^ seeds[rows.start + doc])
        h[h == 0] = 1  # 0 is what follows the last word
        ends_before = np.concatenate([[0], np.cumsum(PIECE_ENDS[words.data], dtype=np.int64)])[words.starts]
        last = np.ones(len(h), dtype=bool)
        last[:-1] = (ends_before[1:] != ends_before[:-1]) | (doc[1:] != doc[:-1])
        yield words, h, rows.start + doc, last


def count_words(docs: DataFrame) -> DataFrame:
    """lang, h, word, f: all words with their counts. ``docs`` has _lang and _text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("_lang").fill_null(NO_LANG)
            for words, h, row, _ in _read(batch):
                _, at, f = np.unique(h, return_index=True, return_counts=True)
                # Words and what lies between them are the alternate parts of the text.
                bounds = np.column_stack([words.starts, words.ends]).ravel()
                low = tx.LOWER[words.data]
                parts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                              [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(row[at])), pa.array(h[at].view(np.int64)), parts.take(pa.array(2 * at)).cast(pa.binary()),
                     pa.array(f, pa.int64())], names=["lang", "h", "word", "f"])

    found = docs.mapInArrow(count, "lang string, h bigint, word binary, f bigint")
    return found.groupBy("lang", "h", "word").agg(F.sum("f").alias("f"))


def word_map(frequent: DataFrame) -> Broadcast:
    """Bits of the hashes of frequent words: 2**MAP_BITS bits whatever their number."""
    bit = F.shiftrightunsigned("h", 64 - MAP_BITS)
    words = frequent.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(table)


def _prefix(before: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix from that of the one before and its last word."""
    with np.errstate(over="ignore"):
        return tx.mix(word if before is None else tx.mix(before * U64(0x9E3779B97F4A7C15)) + word)


def _goes_on(h: np.ndarray, last: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each word and the next one stand in one piece and are both frequent, as far as the map tells."""
    at = h >> U64(64 - MAP_BITS)
    keep = (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)).astype(np.int64)) & 1 == 1
    goes = keep & ~last
    goes[:-1] &= keep[1:]
    goes[-1:] = False
    return goes


def _buckets(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Buckets of the pairs that start at these words."""
    return (_prefix(_prefix(None, h[start]), h[start + 1]) >> U64(64 - PAIR_BITS)).astype(np.int64)


def _cut(groups: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal numbers, cut at ``most``."""
    new = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.empty(0, np.int64)
    inside = np.arange(len(groups)) - np.repeat(new, np.diff(np.append(new, len(groups))))
    at = np.flatnonzero(inside % most == 0)
    return at, np.append(at, len(groups))[1:]


def pair_map(docs: DataFrame, bits: Broadcast, least: int) -> Broadcast:
    """Bits of the buckets that at least ``least`` pairs of frequent neighbours fall into: 2**PAIR_BITS bits whatever the
    text. Counts of a task's pieces are merged by ranges of buckets, each a dense array of fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, _, last in _read(batch):
                bucket, f = np.unique(_buckets(h, np.flatnonzero(_goes_on(h, last, bits.value))), return_counts=True)
                at, stop = _cut(bucket >> RANGE_BITS, ROW_PAIRS)
                low = (bucket & ((1 << RANGE_BITS) - 1)).astype(np.uint32)
                step = np.diff(low, prepend=np.uint32(0))
                step[at] = low[at]
                packed = [tx.planes(step[i:j]) + tx.planes(f[i:j].astype(np.uint32)) for i, j in zip(at, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array((bucket[at] >> RANGE_BITS).astype(np.int32)), pa.array(packed, pa.binary())],
                                                 names=["range", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << RANGE_BITS, dtype=np.int64)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())],
                                              names=["range", "bits"])

        for batch in batches:
            for r, packed in zip(batch.column("range").to_pylist(), batch.column("packed"), strict=True):
                if r != now:
                    if now is not None:
                        yield done()
                    now = r
                    total[:] = 0
                raw = packed.as_buffer()
                n = raw.size // 8
                # Buckets of one row differ.
                total[np.cumsum(tx.from_planes(raw[:4 * n], np.uint32, n).astype(np.int64))] += tx.from_planes(raw[4 * n:], np.uint32, n)
        if now is not None:
            yield done()

    counted = docs.mapInArrow(count, "range int, packed binary")
    found = counted.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "range int, bits binary").toArrow()
    size = 1 << (RANGE_BITS - 3)
    table = np.zeros(1 << (PAIR_BITS - 3), dtype=np.uint8)
    for r, part in zip(found.column("range").to_pylist(), found.column("bits").to_pylist(), strict=True):
        table[r * size:(r + 1) * size] = np.frombuffer(part, dtype=np.uint8)
    return docs.sparkSession.sparkContext.broadcast(table)


def _suffixes(h: np.ndarray, last: np.ndarray, bits: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Suffixes of two words or more that start at each word, cut at LONGEST words, at the end of a piece and where a word
    or a pair is not frequent; one row each, zeros behind the last word."""
    n = len(h)
    goes = _goes_on(h, last, bits)
    start = np.flatnonzero(goes)
    bucket = _buckets(h, start)
    often = (pairs[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
    goes[start[~often]] = False
    start = start[often]
    out = np.zeros((LONGEST, len(start)), dtype=U64)
    out[0], out[1] = h[start], h[start + 1]
    alive = np.arange(len(start))
    for k in range(2, LONGEST):
        alive = alive[goes[np.minimum(start[alive] + k - 1, n - 1)]]
        out[k, alive] = h[start[alive] + k]
    return out


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _group_prefix(suffixes: np.ndarray, extended: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of the prefix that each suffix is dealt by: the shortest that is not extended."""
    key = _prefix(None, suffixes[0])
    depth = np.ones(len(key), dtype=np.int64)
    open_ = np.arange(len(key))
    for k, hot in enumerate(extended[:LONGEST - 1], start=1):
        open_ = open_[_in(hot, key[open_])]
        key[open_] = _prefix(key[open_], suffixes[k, open_])
        depth[open_] = k + 1
    return key, depth


def _merge(columns: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal columns as one, in lexicographic order, counts added."""
    order = np.lexsort(columns[::-1])
    columns, count = columns[:, order], count[order]
    first = np.ones(columns.shape[1], dtype=bool)
    first[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    at = np.flatnonzero(first)
    return columns[:, at], np.add.reduceat(count, at) if len(at) else count


def _combine(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal columns as one, in the order of a hash; a column may come twice where hashes meet."""
    key = None
    for row in columns:
        key = _prefix(key, row)
    order = np.argsort(key, kind="stable")
    columns = columns[:, order]
    first = np.ones(columns.shape[1], dtype=bool)
    first[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    at = np.flatnonzero(first)
    return columns[:, at], np.diff(np.append(at, columns.shape[1]))


def _extensions(docs: DataFrame, bits: Broadcast, pairs: Broadcast, extended: list[np.ndarray]) -> DataFrame:
    """w1.., f: counts of the prefixes one word longer than the extended ones of the last level."""
    level = len(extended) + 1
    names = [f"w{k}" for k in range(1, level + 1)]
    hot = docs.sparkSession.sparkContext.broadcast(extended)

    def rows_of(found: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(w.view(np.int64)) for w in found), pa.array(f, pa.int64())], names=[*names, "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty((level, 0), U64), np.empty(0, np.int64))
        for batch in batches:
            for _, h, _, last in _read(batch):
                found = _suffixes(h, last, bits.value, pairs.value)
                _, depth = _group_prefix(found, hot.value)
                found, f = _combine(found[:level, depth == level])
                held = _merge(np.concatenate([held[0], found], axis=1), np.concatenate([held[1], f]))
                # A task hands out what it has counted when that outgrows a budget, and at its end.
                if len(held[1]) > BUDGET:
                    yield rows_of(*held)
                    held = (held[0][:, :0], held[1][:0])
        yield rows_of(*held)

    rows = docs.mapInArrow(count, ", ".join(f"{c} bigint" for c in [*names, "f"]))
    return rows.groupBy(*names).agg(F.sum("f").alias("f"))


def _subtrees(least: int):
    """Nodes of each group's subtrees from packed suffixes that come sorted by group: words w1..w5 (0: none) and count."""
    names = [f"w{k}" for k in range(1, LONGEST + 1)]

    def nodes(columns: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        depth, columns = columns[0].astype(np.int64), columns[1:]
        new = np.zeros(columns.shape[1], dtype=bool)
        new[:1] = True
        for k in range(1, LONGEST + 1):
            new[1:] |= columns[k - 1, 1:] != columns[k - 1, :-1]
            if k == 1:
                continue
            at = np.flatnonzero(new)
            f = np.add.reduceat(count, at) if len(at) else count
            # Nodes above a group's own prefix are shared with other groups; their counts come from the levels.
            real = (columns[k - 1, at] != 0) & (f >= least) & (k >= depth[at])
            at, f = at[real], f[real]
            words = [columns[j, at] if j < k else np.zeros(len(at), U64) for j in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([*(pa.array(w.view(np.int64)) for w in words), pa.array(f, pa.int64())], names=[*names, "f"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, columns, counts, held = None, [], [], 0

        def shrink():
            nonlocal columns, counts, held
            merged, total = _merge(np.concatenate(columns, axis=1), np.concatenate(counts))
            columns, counts, held = [merged], [total], 0

        for batch in batches:
            for g, n, packed in zip(batch.column("grp").to_pylist(), batch.column("n").to_pylist(), batch.column("packed"), strict=True):
                if g != group:
                    if columns:
                        shrink()
                        yield from nodes(columns[0], counts[0])
                    group, columns, counts, held = g, [], [], 0
                raw = packed.as_buffer()
                table = np.frombuffer(raw, dtype=U64).reshape(LONGEST + 2, n)
                columns.append(table[:-1])
                counts.append(table[-1].astype(np.int64))
                held += n
                # Copies of one suffix from many tasks never pile up: what a group holds is its distinct suffixes.
                if held > 2 * BUDGET:
                    shrink()
        if columns:
            shrink()
            yield from nodes(columns[0], counts[0])

    return build, ", ".join(f"{c} bigint" for c in [*names, "f"])


def count_phrases(docs: DataFrame, words: DataFrame, least: int = 100, budget: int = BUDGET) -> DataFrame:
    """w (hashes of 2 to LONGEST words), f: every phrase found at least ``least`` times. ``docs`` has _lang and _text,
    ``words`` are those of ``count_words``, stored."""
    spark = docs.sparkSession
    bits = word_map(words.filter(F.col("f") >= least))
    pairs = pair_map(docs, bits, least)
    total = words.agg(F.sum("f")).head()[0] or 0
    # Prefixes of more than a budget are at most MOST_PREFIXES a level, so what is sent to tasks has a bound.
    budget = max(budget, -(-total // MOST_PREFIXES))
    groups = max(1, -(-total // budget))
    names = [f"w{k}" for k in range(1, LONGEST + 1)]
    hot_rows = []
    first = words.filter(F.col("f") > budget).select("h").toArrow().column("h").to_numpy().astype(np.int64)
    extended = [np.sort(_prefix(None, first.view(U64)))]
    while len(extended[-1]) and len(extended) < LONGEST - 1:
        level = len(extended) + 1
        hot = _extensions(docs, bits, pairs, extended).filter(F.col("f") > budget).toArrow()
        columns = [hot.column(c).to_numpy().astype(np.int64) for c in names[:level]]
        key = None
        for c in columns:
            key = _prefix(key, c.view(U64))
        extended.append(np.sort(key))
        # These nodes stand above their groups, so their counts are taken from here.
        hot_rows += [([int(c[i]) for c in columns], f) for i, f in enumerate(hot.column("f").to_pylist()) if columns[-1][i] != 0]
    shared = spark.sparkContext.broadcast(extended)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, _, last in _read(batch):
                found, f = _combine(_suffixes(h, last, bits.value, pairs.value))
                key, depth = _group_prefix(found, shared.value)
                group = ((key >> U64(32)) * U64(groups) >> U64(32)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                table = np.vstack([depth[None].astype(U64), found, f[None].astype(U64)])[:, order]
                group = group[order]
                at, stop = _cut(group, ROW_SUFFIXES)
                # Columns of zeros and of small numbers are what the shuffle's compression is good at.
                packed = [np.ascontiguousarray(table[:, i:j]).tobytes() for i, j in zip(at, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(group[at], pa.int64()), pa.array(stop - at, pa.int32()), pa.array(packed, pa.binary())],
                                                 names=["grp", "n", "packed"])

    build, schema = _subtrees(least)
    dealt = docs.mapInArrow(deal, "grp bigint, n int, packed binary")
    # A few groups a task, however many there are; a number that is asked for is not merged again.
    tasks = max(tx.parallelism(spark), -(-groups // 2))
    nodes = dealt.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(build, schema)
    # Words that passed the map by chance are in nodes too; their nodes are below the least count and gone already.
    counted = nodes.select(F.filter(F.array(*names), lambda x: x != 0).alias("w"), "f")
    return counted.unionByName(spark.createDataFrame(hot_rows, "w array<bigint>, f bigint")) if hot_rows else counted


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int = 2000, cover: int = 100,
                 budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language by score, then count (both
    descending), then the bytes of the phrase.

    Texts are lower-cased in A-Z and cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs.
    A phrase of 2 to 5 words found a >= ``least`` times in its language is a candidate; cutting it into parts found l and r
    times gives floor(1000 * a * n / (l * r)), n being the language's words, and the lowest score counts (the earliest cut
    of equal ones). Candidates inside a longer one that is found at least ``cover`` percent as often go.

    Whole texts are read; null and empty ones have no words; a null language is ``und``. Repeated rows count each time,
    ids do not matter, nor do further columns. An empty table gives an empty result. Runs jobs while the plan is built."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("_lang"), F.col(text).cast("string").alias("_text"))
    words = materialize(count_words(source))
    frequent = words.filter(F.col("f") >= least)
    size = words.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = materialize(count_phrases(source, words, least, budget))

    parts = phrases.unionByName(frequent.select(F.array("h").alias("w"), "f"))
    cuts = (phrases.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
            .withColumns({"left": F.expr("slice(w, 1, k)"), "right": F.expr("slice(w, k + 1, size(w) - k)")}))
    # One longer is enough: between a candidate and a longer one around it counts only fall.
    longer = phrases.filter(F.size("w") > 2)
    inside = (longer.select(F.expr("slice(w, 1, size(w) - 1)").alias("w"), F.col("f").alias("around"))
              .unionByName(longer.select(F.expr("slice(w, 2, size(w) - 1)").alias("w"), F.col("f").alias("around")))
              .groupBy("w").agg(F.max("around").alias("around")))
    bare = cuts.join(parts.select(F.col("w").alias("left"), F.col("f").alias("l")), "left").join(
        parts.select(F.col("w").alias("right"), F.col("f").alias("r")), "right")
    whole = (phrases.join(inside, "w", "left").filter(F.col("around").isNull() | (100 * F.col("around") < cover * F.col("f")))
             .select("w", F.col("w")[0].alias("h")).join(frequent.select("h", "lang"), "h").join(size, "lang").select("w", "lang", "n"))
    exact = "cast(cast(1000 * cast(a as decimal(18,0)) as decimal(20,0)) * cast(n as decimal(18,0)) as decimal(38,0))"
    scored = (bare.join(whole, "w")
              .withColumn("score", F.expr(f"{exact} div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"))
              .groupBy("lang", "w", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "w", "a", "cut.l", "cut.r", "n", "cut.score"))
    # Ties at the last place stay until their words are known.
    by = [F.desc("score"), F.desc("a")]
    near = materialize(scored.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("_rank") <= top).drop("_rank"))
    spelled = (near.select("w", F.posexplode("w").alias("pos", "h")).join(frequent.select("h", "word"), "h")
               .groupBy("w").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))).alias("words"))
               .select("w", F.array_join("words.word", " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(*by, F.asc("phrase"))
    return (near.join(spelled, "w").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
