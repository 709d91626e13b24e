"""MinHash near-dedup by a multi-index join over Hamming distance.

Each text's set of word shingles becomes a signature of ``SYMBOLS`` minima of ``BITS`` bits. Two signatures that differ
in at most ``DISTANCE`` symbols agree, by pigeonhole, in all but one symbol (or all) of at least one of ``CHUNKS`` chunks.
So each chunk is filed under one key for each symbol that may be wrong, the rest of the chunk being the key: 64 keys a
text, and every pair within the distance shares one. At a similarity of 0.75 symbols differ with probability 0.25, and
more than 31 of 64 with about 1 in 100,000; pairs that share a key are compared on their full sets.

Pairs are not sent for a group of equal keys. Texts with the same set are one class from the start. In each group all
classes are compared with the smallest one (a star), and what is linked becomes one component. Only groups that then
still hold several components are looked at again: their members that have a partner of another component within the
distance meet in cells, with their sets. There, pairs of different components are compared until they are one, each pair
in the cell of the first key that it shares, and only the links that join components leave the cell. The links found
connect whatever all pairs would connect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize
from . import text as tx

SHINGLE = 5
SYMBOLS, BITS, CHUNKS = 64, 16, 16
PER_CHUNK = SYMBOLS // CHUNKS
ERRORS = 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Links: PERCENT[1] * intersection >= PERCENT[0] * union.
PERCENT = (75, 100)
#: Rows of a group that one task compares at a time; texts per copy of a center.
CELL, STAR = 4096, 1024
#: Bits of the map that keeps unconcerned texts from being sent: 4 MB.
MAP_BITS = 25

_r = np.random.Generator(np.random.PCG64(75))
_XOR = _r.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_ODD = _r.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SKETCH = "n_shingles bigint, s1 bigint, s2 bigint, sig binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    words = tx.split_words(data, offsets, fold=tx.LOWER)
    h = words.hashes()
    full = tx.windows(h, SHINGLE)
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(full[lo:hi - SHINGLE + 1])
        elif hi > lo:
            yield tx.windows(h[lo:hi], int(hi - lo))
        else:
            yield full[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima under SYMBOLS permutations of 32-bit values, cut to BITS bits."""
    least = np.full(SYMBOLS, 0xFFFFFFFF, dtype=np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 4096):
        np.minimum(least, ((values[at:at + 4096, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in tx.text_pieces(batch, "_text"):
            n, s1, s2, sig = [], [], [], []
            for s in shingle_sets(data, offsets):
                n.append(len(s))
                s1.append(s.sum(dtype=np.uint64))
                s2.append(tx.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                sig.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(rows.start, len(n)), pa.array(n, pa.int64()),
                 pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
                 pa.array(sig, pa.binary())], names=["doc", "n_shingles", "s1", "s2", "sig"])


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each class: chunk, symbol that may be wrong, the chunk's other symbols."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sig = _signatures(part.column("sig")).reshape(-1, CHUNKS, PER_CHUNK).astype(np.int64)
            keys = np.empty((len(sig), CHUNKS, PER_CHUNK), dtype=np.int64)
            for wrong in range(PER_CHUNK):
                key = np.arange(CHUNKS, dtype=np.int64)[None, :] * PER_CHUNK + wrong
                for k in range(PER_CHUNK):
                    if k != wrong:
                        key = (key << BITS) | sig[:, :, k]
                keys[:, :, wrong] = key
            ids = np.repeat(part.column("rep").to_numpy(), CHUNKS * PER_CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "rep"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose signatures are within the distance."""
    for batch in batches:
        if batch.num_rows:
            far = (_signatures(batch.column("sig_a")) != _signatures(batch.column("sig_b"))).sum(axis=1)
            yield batch.filter(pa.array(far <= DISTANCE)).select(["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a center, then the texts to compare with it."""
    center, center_set = None, None
    for batch in batches:
        for rows, data, offsets in tx.text_pieces(batch, "_text"):
            part = batch.slice(rows.start, rows.stop - rows.start)
            a, b, role = (part.column(c).to_pylist() for c in ("a", "b", "role"))
            linked = []
            for i, s in enumerate(shingle_sets(data, offsets)):
                if role[i] == 0:
                    center, center_set = a[i], s
                    linked.append(False)
                else:
                    at = np.minimum(np.searchsorted(center_set, s), len(center_set) - 1)
                    both = int((center_set[at] == s).sum()) if center == a[i] else 0
                    linked.append(PERCENT[1] * both >= PERCENT[0] * (len(s) + len(center_set) - both))
            keep = [i for i in range(len(a)) if role[i] == 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()),
                 pa.array([linked[i] for i in keep], pa.bool_())], names=["a", "b", "linked"])


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts whose id may be in ``ids``, before they are sent to a join with it: a bit map of the ids' hashes, of a fixed
    size, drops most of the others. When the ids outgrow the map it drops fewer; the join decides."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << MAP_BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def maybe(bits: pa.Array) -> pa.Array:
        b = bits.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array((shared.value[b >> 6] >> (b & 63)) & 1 == 1)

    return texts.filter(maybe(bit))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked: the pairs, each compared on its full sets. A center with many partners is copied, once per STAR."""
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("cuts"))
    partners = pairs.join(fan, "a").select(
        F.col("b").alias("doc"), "a", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int").alias("cut"), F.lit(1).alias("role"))
    centers = fan.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"),
                         F.lit(0).alias("role"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    rows = partners.unionByName(centers).join(_only(texts, wanted), "doc").select("a", "cut", "role", F.col("doc").alias("b"), "_text")
    return (rows.repartition("a", "cut").sortWithinPartitions("a", "cut", "role")
            .mapInArrow(tx.tidy(_compare), "a bigint, b bigint, linked boolean"))


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable, for every id in ``links`` (a, b). Alternates large and small stars: each
    round hangs neighbours on the smallest one, so the depth falls by a constant factor."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = materialize(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
        state = now


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows come sorted by cell (key, lo, hi): one table for each."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True))
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for x, y in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if keys[x] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield now, pa.Table.from_batches(held)


def _open(cell: tuple, t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows): pairs of different components within the distance whose first shared key is this cell's. One side is
    outside the component with the most rows."""
    key, lo, hi = cell
    label, size, side = (t.column(c).to_numpy() for c in ("label", "n_shingles", "side"))
    names, times = np.unique(label, return_counts=True)
    if len(names) < 2 or (lo != hi and len(np.unique(side)) < 2):
        return
    sig = _signatures(t.column("sig"))
    most = names[times.argmax()]
    pickers = np.flatnonzero(label != most)
    for at in range(0, len(pickers), 256):
        rows = pickers[at:at + 256]
        far = np.zeros((len(rows), len(label)), dtype=np.uint8)
        for k in range(SYMBOLS):
            far += sig[rows, k][:, None] != sig[None, :, k]
        less, more = np.minimum(size[rows][:, None], size), np.maximum(size[rows][:, None], size)
        ok = (far <= DISTANCE) & (label[rows][:, None] != label) & (PERCENT[1] * less >= PERCENT[0] * more)
        # Of two rows outside the largest component, the first one names the other.
        ok &= (label == most) | (np.arange(len(label)) > rows[:, None])
        if lo != hi:
            ok &= side[rows][:, None] != side
        for i in np.flatnonzero(ok.any(axis=1)).tolist():
            js = np.flatnonzero(ok[i])
            same = (sig[rows[i]] == sig[js]).reshape(-1, CHUNKS, PER_CHUNK)
            others = same.sum(axis=2, dtype=np.int64)[:, :, None] - same
            first = (others == PER_CHUNK - 1).reshape(len(js), -1).argmax(axis=1)
            js = js[first == key >> (BITS * (PER_CHUNK - 1))]
            if len(js):
                yield int(rows[i]), js


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that have an open pair there."""
    for cell, t in _cells(batches):
        hit = np.zeros(t.num_rows, dtype=bool)
        for i, js in _open(cell, t):
            hit[i] = True
            hit[js] = True
        yield from t.filter(pa.array(hit)).to_batches()


def _join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components, found by comparing the open pairs of each cell on their full sets."""
    for cell, t in _cells(batches):
        ids, label = t.column("rep").to_numpy(), t.column("label").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        _, group = np.unique(label, return_inverse=True)
        root = np.arange(group.max() + 1)
        a, b = [], []
        for i, js in _open(cell, t):
            js = js[root[group[js]] != root[group[i]]]
            if not len(js):
                continue
            at = np.minimum(np.searchsorted(sets[i], flat := np.concatenate([sets[j] for j in js])), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(sizes[js]) - sizes[js])
            for j in js[PERCENT[1] * both >= PERCENT[0] * (sizes[i] + sizes[js] - both)].tolist():
                x, y = root[group[i]], root[group[j]]
                if x != y:
                    root[root == y] = x
                    a.append(ids[i])
                    b.append(ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in tx.text_pieces(batch, "_text"):
            part = batch.slice(rows.start, rows.stop - rows.start)
            sets = pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("rep"), sets], names=["rep", "set"])


def _crowded_links(crowds: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links between different components within groups of three or more. A large group is cut into cells: blocks
    of rows against blocks of rows."""
    tagged = crowds.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    split = (tagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
             .filter("x <> y").select("key", F.ceil(F.col("n") / CELL).cast("int").alias("blocks")))
    cell = ["key", "lo", "hi"]
    rows = (tagged.join(split, "key").join(classes.select("rep", "n_shingles", "sig"), "rep")
            .withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rep", "label",
                    "n_shingles", "sig"))
    schema = "key bigint, lo int, hi int, side int, rep bigint, label bigint, n_shingles bigint, sig binary"
    active = materialize(rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(tx.tidy(_active), schema))
    wanted = active.select("rep").distinct()
    # One text for each class: the rows of its smallest id that have its set size.
    near = _only(texts, wanted.select(F.col("rep").alias("doc")))
    sets = (near.withColumnRenamed("doc", "rep").join(wanted, "rep").mapInArrow(tx.tidy(_to_sets), "rep bigint, set binary")
            .withColumn("n_shingles", (F.octet_length("set") / 8).cast("bigint")).dropDuplicates(["rep", "n_shingles"]))
    return (active.join(sets, ["rep", "n_shingles"]).select(*[c.split()[0] for c in schema.split(", ")], "set")
            .repartition(*cell).sortWithinPartitions(*cell).mapInArrow(tx.tidy(_join_cells), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable over links, itself
    included), ``kept`` (the id is that smallest one). Ids are integers.

    Null and blank texts have no shingles and are linked with nothing. Repeated rows share their id and so their
    component. A row without id is linked with nothing: its component is null and it is kept. An empty table gives an
    empty result. The plan runs jobs while it is built."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("_text"))
    sketches = materialize(source.mapInArrow(tx.tidy(_sketch), f"doc bigint, {SKETCH}"))
    same = ["s1", "s2", "n_shingles"]
    classes = materialize(sketches.filter("n_shingles > 0 and doc is not null").groupBy(*same).agg(
        F.min("doc").alias("rep"), F.first("sig").alias("sig")))
    keys = classes.select("rep", "sig").mapInArrow(tx.tidy(_file), "key bigint, rep bigint")
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("center")).filter("n > 1")
    shared = materialize(keys.join(groups, "key"))
    stars = shared.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    crowds = shared.filter("n > 2").select("key", "rep")
    size_ok = PERCENT[1] * F.least("n_a", "n_b") >= PERCENT[0] * F.greatest("n_a", "n_b")

    def side(which: str) -> DataFrame:
        return classes.select(F.col("rep").alias(which), F.col("n_shingles").alias(f"n_{which}"), F.col("sig").alias(f"sig_{which}"))

    pairs = materialize(stars.join(side("a"), "a").join(side("b"), "b").filter(size_ok)
                        .select("a", "b", "sig_a", "sig_b").mapInArrow(tx.tidy(_near), "a bigint, b bigint"))
    texts = source
    tested = materialize(_verify(pairs, texts))
    linked = tested.filter("linked").select("a", "b")
    labels = components(linked)
    more = materialize(_crowded_links(crowds, classes, labels, texts))
    if not more.isEmpty():
        # Labels of the first round stand for their links.
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more))
    of_class = (classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
                .select(*same, F.coalesce("label", "rep").alias("component_id")))
    return (sketches.join(of_class, same, "left")
            .select(F.col("doc").alias(doc_id), "n_shingles",
                    F.when(F.col("doc").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc"))).alias("component_id"))
            .withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id"))))
