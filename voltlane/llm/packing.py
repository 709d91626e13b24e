"""Packing documents into fixed-length sequences by first-fit decreasing.

Documents are tokenized where they are read; only piece lengths and checksums move. A document longer than a sequence is
cut into full sequences, which need no packing, and a rest. Rests are dealt at random into groups of about ``GROUP``
pieces, and each group is packed on its own: longest first, into the first bin with room, found by walking down a
tournament tree whose inner nodes hold the larger room of their two halves."""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize
from . import text as tx

LENGTH = 2048
END_ID = 1
GROUP = 20_000
#: Parts of words whose ids a worker remembers; the memory starts anew when it is full.
REMEMBERED = 600_000
#: Parts or words that are encoded in one text, and the control character between words.
TOGETHER = 512
MARK = b"\x01"
SPECIAL = b"<|"
#: Bytes that plain words have not: any beyond ASCII but those of Latin-1 letters in UTF-8.
NOT_PLAIN = bytes([0xC2, *range(0xC4, 0x100)])
TIMES, DIVIDED = "\u00d7".encode(), "\u00f7".encode()
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

_encoders: dict[str, _Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(x: bytes) -> bool:
    return len(x.translate(None, NOT_PLAIN)) == len(x) and SPECIAL not in x and TIMES not in x and DIVIDED not in x


class _Encoder:
    """Ids of texts as little-endian bytes, from the remembered ids of their parts.

    The tokenizer's split pattern parts words, and each part is encoded alone, with a word-end suffix on its last token; so
    many distinct parts go in one text, and the suffix tells them apart. Plain words (ASCII and Latin-1 letters) are parted
    by the same pattern over bytes. Other words are remembered whole and encoded with ``MARK`` between them, whose id no
    other character gives; words with the mark or a special token's opening are encoded one by one. A tokenizer without
    such a pattern, suffix or mark gets whole texts, and nothing is remembered."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(spec), {}
        settings = json.loads(spec)
        suffix = settings["model"].get("end_of_word_suffix")
        splits = [x for x in (settings["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        pattern = splits[0]["pattern"].get("Regex", "") if len(splits) == 1 else ""
        pattern = pattern.encode().replace(rb"\p{L}", rb"a-z\x80-\xff").replace(rb"\p{N}", b"0-9")
        mark = self._encode([MARK])[0]
        self.mark = mark[0]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        self.parts = re.compile(pattern).findall if suffix and pattern and rb"\p" not in pattern and len(mark) == 1 else None

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _remember(self, keys: list[bytes], ids: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> None:
        if len(begins) != len(keys) or len(stops) != len(keys) or stops[-1] != len(ids):
            raise ValueError("the tokenizer does not keep words apart")
        raw = ids.tobytes()
        self.known.update(zip(keys, [raw[lo:hi] for lo, hi in zip((4 * begins).tolist(), (4 * stops).tolist(), strict=True)], strict=True))

    def _learn(self, keys: set[bytes]) -> None:
        new = keys.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = keys
        plain, marked, alone = [], [], []
        for x in new:
            (plain if _plain(x) else alone if MARK in x or SPECIAL in x else marked).append(x)
        for some in (plain[at:at + TOGETHER] for at in range(0, len(plain), TOGETHER)):
            ids = self._encode([b" ".join(some)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            self._remember(some, ids, np.append(0, stops[:-1]), stops)
        for some in (marked[at:at + TOGETHER] for at in range(0, len(marked), TOGETHER)):
            ids = self._encode([(b" " + MARK + b" ").join(some)])[0]
            cuts = np.flatnonzero(ids == self.mark)
            self._remember(some, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))
        for some in (alone[at:at + TOGETHER] for at in range(0, len(alone), TOGETHER)):
            self.known.update(zip(some, [x.tobytes() for x in self._encode(some)], strict=True))

    def _keys(self, text: bytes) -> list[bytes]:
        if _plain(text):
            return self.parts(text.lower())
        return [k for w in text.split() for k in (self.parts(w.lower()) if _plain(w) else [w])]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.parts:
            return (x.tobytes() for x in self._encode(texts))
        keys = [self._keys(t) for t in texts]
        self._learn(set().union(*keys))
        return (b"".join(map(self.known.__getitem__, k)) for k in keys)


def _encoder(spec: str) -> _Encoder:
    if spec not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[spec] = _Encoder(spec)
    return _encoders[spec]


def _pieces(spec: str, length: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for rows, data, offsets in tx.text_pieces(batch, "_text", tx.BLOCK):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                doc, start, size, crc, total, ids = [], [], [], [], [], []
                for d, body in enumerate(encoder.encode(texts)):
                    packed = body + end
                    n = len(packed) // 4
                    for at in range(0, n, length):
                        piece = packed[4 * at:4 * (at + length)]
                        doc.append(d)
                        start.append(at)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                out = [batch.column("doc").slice(rows.start, rows.stop - rows.start).take(pa.array(doc))]
                out += [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
                names = ["doc", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return cut


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size; ties in the order given."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        node >>= 1
        while node:
            largest = max(room[2 * node], room[2 * node + 1])
            if room[node] == largest:
                break
            room[node] = largest
            node >>= 1
    return bins, offsets


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH,
         end_id: int = END_ID, group: int = GROUP, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``start`` (its document's ids before it), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``; with ``with_ids`` also ``ids``. ``vocabulary`` is a tokenizer file, read on the driver.

    A null or empty text is its end id alone. Repeated rows are packed each. Offsets in a sequence run without gaps from 0;
    sequence ids are unique, not gapless. An empty table gives no pieces. The plan runs jobs while it is built: pieces are
    stored once, so a repeated task sees the same groups."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("_text"))
    kind = dict(source.dtypes)["doc"]
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    pieces = source.mapInArrow(tx.tidy(_pieces(spec, length, end_id, with_ids)), f"doc {kind}, {PIECES}{', ids array<int>' * with_ids}")
    pieces = materialize(pieces.withColumn("_rid", F.monotonically_increasing_id()))
    full = F.col("length") == length
    rests = pieces.filter(~full)
    groups = max(1, math.ceil(rests.count() / group))
    slim = rests.select(F.pmod(F.xxhash64("_rid", F.lit(seed)), F.lit(groups)).alias("_group"), "_rid", "length")

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rid")
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
        return pa.table({"_rid": table.column("_rid"), "sequence_id": (table.column("_group").to_numpy() * (1 << 32) + bins) * 2,
                         "offset": offsets})

    placed = slim.groupBy("_group").applyInArrow(place, "_rid bigint, sequence_id bigint, offset bigint")
    out = (rests.join(placed, "_rid").drop("_rid")
           .unionByName(pieces.filter(full).withColumn("sequence_id", F.col("_rid") * 2 + 1)
                        .withColumn("offset", F.lit(0).cast("bigint")).drop("_rid")))
    return out.select(F.col("doc").alias(doc_id), *names, "sequence_id", "offset")
