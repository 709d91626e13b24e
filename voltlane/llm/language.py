"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are read as streams of lower-case letters with one blank between runs of them. Counts of all character 4-grams of
all learning texts are gathered by Spark; they settle the lower orders too, which count distinct left neighbours. The
probabilities of each order are kept in sorted arrays of packed 4-gram keys (16 bits a character, so the key is its own
hash; the bits are a letter's number in the alphabet of the learning texts, so letters beyond U+FFFF are told apart too), and looked up by binary search, once per distinct 4-gram of a batch.

No count is dropped. The table of counts stays in Spark, cut into slices by the two middle characters of the 4-gram: all
that a 4-gram's probability needs (its context, its shorter forms and their contexts) is in its own slice, but for the
single characters and one discount per order, which are totals of the whole table. Slices are collected, sent out and
applied to the texts one after the other, and the sums of a text are added up; up to ``SLICE_GRAMS`` there is one slice.

A text goes to the language with the lowest cross-entropy per character. The rejection is calibrated on the learning
texts: from the mean and spread of each language's own cross-entropy, a text that fits its best language worse than
``SPREADS`` standard deviations above the mean is marked as not accepted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize
from . import text as tx

ORDER = 4
BITS = 16
SPREADS = 4.0
SHARPNESS = 20.0
#: About how many 4-grams (of all languages, 16 bytes each) are held in memory at a time, and most languages.
SLICE_GRAMS = 4_000_000
MAX_LANGUAGES = 500
FLUSH = 1 << 21
BLANK = 0x20

#: Beyond these planes Unicode has no letters.
CODES = 0x40000

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code below CODES its lower-case letter, or a blank; the last entry, a blank, stands for all codes beyond."""
    if not _tables:
        table = np.full(CODES + 1, BLANK, dtype=np.uint32)
        for c in range(CODES):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def _characters(data: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return _letters()[np.minimum(codes, CODES)]


def _alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct letters of the texts."""
    seen = np.zeros(CODES, dtype=bool)
    for batch in batches:
        for _, data, offsets in tx.text_pieces(batch, "_text"):
            seen[_characters(data[offsets[0]:offsets[-1]])] = True
    seen[BLANK] = False
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], names=["code"])


def numbers(alphabet: np.ndarray) -> np.ndarray:
    """A table from characters to 16 bits: 0 for a blank, 1 for all letters that no learning text has (no model tells them
    apart), then the alphabet."""
    if len(alphabet) > (1 << BITS) - 2:
        raise ValueError(f"{len(alphabet)} distinct letters; {(1 << BITS) - 2} at most")
    table = np.ones(CODES, dtype=np.uint16)
    table[alphabet] = np.arange(2, 2 + len(alphabet))
    table[BLANK] = 0
    return table


def char_grams(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed 4-grams in text order, text of each, letters per text). Each text is led by blanks, so it has as many
    4-grams as characters."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = data[lo:hi]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])[offsets - lo]
    c = table[_characters(data)]
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(heads))
    blank = c == 0
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
    firsts = heads[:-1][np.diff(heads) > 0]
    keep[firsts] &= ~blank[firsts]
    c, doc = c[keep], doc[keep]
    padded = np.zeros(len(c) + (ORDER - 1) * n_docs, dtype=np.uint64)
    at = np.arange(len(c)) + (ORDER - 1) * (doc + 1)
    padded[at] = c
    grams = padded[at]
    for k in range(1, ORDER):
        grams = grams | (padded[at - k] << np.uint64(BITS * k))
    return grams, doc, np.bincount(doc[c != 0], minlength=n_docs)


def _count(alphabet):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = numbers(alphabet.value)
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(which, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)],
                                                 names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for rows, data, offsets in tx.text_pieces(batch, "_text"):
                langs = np.array(batch.column("lang").slice(rows.start, rows.stop - rows.start).to_pylist(), dtype=object)
                grams, doc, _ = char_grams(data, offsets, table)
                names, code = np.unique(langs.astype(str), return_inverse=True)
                for i, lang in enumerate(names):
                    keys, n = np.unique(grams[code[doc] == i], return_counts=True)
                    held.setdefault(str(lang), []).append((keys, n))
                    size += len(keys)
            if size >= FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return count


def _middle(grams: np.ndarray) -> np.ndarray:
    """Third character, then the second: 4-grams between two of these numbers are a slice."""
    low = np.uint64((1 << BITS) - 1)
    return ((grams >> np.uint64(BITS)) & low) << np.uint64(BITS) | ((grams >> np.uint64(2 * BITS)) & low)


def _discount(once: int, twice: int) -> float:
    return float(once / (once + 2 * twice)) if once and twice else 0.75


class KneserNey:
    """A slice of one language: for each order sorted keys, probabilities of seen n-grams, and weights of seen contexts."""

    def __init__(self, singles: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray],
                 grams: tuple[np.ndarray, np.ndarray], discounts: list[float]):
        """Keys and counts of the slice's 4-grams, of all pairs that begin with a third character in it, and of all single
        characters; the language's discounts from order 1 to 4."""
        levels = [(keys[order], n[order].astype(np.float64)) for keys, n in (singles, pairs, grams) for order in [np.argsort(keys)]]
        # Kneser-Ney: a shorter n-gram counts the distinct characters seen before it.
        keys, n = np.unique(levels[2][0] & np.uint64((1 << (BITS * 3)) - 1), return_counts=True)
        levels.insert(2, (keys, n.astype(np.float64)))
        self.levels = []
        keys, n = levels[0]
        vocabulary, d, total = len(keys) + 1, discounts[0], n.sum()
        self.unknown = d * len(n) / total / vocabulary if total else 1.0 / vocabulary
        self.levels.append((keys, np.maximum(n - d, 0) / max(total, 1) + self.unknown, None, None))
        for (keys, n), d in zip(levels[1:], discounts[1:], strict=True):
            contexts, first, types = np.unique(keys >> np.uint64(BITS), return_index=True, return_counts=True)
            totals = np.add.reduceat(n, first) if len(n) else n
            weight = d * types / totals
            which = np.repeat(np.arange(len(contexts)), types)
            lower = self.probability(keys & np.uint64((1 << (BITS * len(self.levels))) - 1), len(self.levels))
            self.levels.append((keys, np.maximum(n - d, 0) / totals[which] + weight[which] * lower, contexts, weight))

    def probability(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last character of each n-gram, given the others."""
        if order == 0:
            return np.full(len(grams), self.unknown)
        keys, prob, contexts, weight = self.levels[order - 1]
        if not len(keys):
            return np.full(len(grams), self.unknown)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        seen = keys[at] == grams
        out = prob[at]
        if not seen.all():
            rest = grams[~seen]
            if order == 1:
                out[~seen] = self.unknown
            else:
                lower = self.probability(rest & np.uint64((1 << (BITS * (order - 1))) - 1), order - 1)
                where = np.minimum(np.searchsorted(contexts, rest >> np.uint64(BITS)), len(contexts) - 1)
                known = contexts[where] == rest >> np.uint64(BITS)
                out[~seen] = np.where(known, weight[where], 1.0) * lower
        return out


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 4-grams and the place of each gram among them. With a small alphabet a direct table replaces the sort."""
    chars = np.zeros(1 << BITS, dtype=bool)
    for k in range(ORDER):
        chars[(grams >> np.uint64(BITS * k)) & np.uint64(0xFFFF)] = True
    alphabet = np.flatnonzero(chars)
    a = len(alphabet)
    if a ** ORDER > 1 << 23:
        return np.unique(grams, return_inverse=True)
    rank = np.cumsum(chars) - 1
    small = np.zeros(len(grams), dtype=np.int64)
    for k in range(ORDER - 1, -1, -1):
        small = small * a + rank[(grams >> np.uint64(BITS * k)) & np.uint64(0xFFFF)]
    seen = np.zeros(a ** ORDER, dtype=bool)
    seen[small] = True
    values = np.flatnonzero(seen)
    places = np.zeros(a ** ORDER, dtype=np.int32)
    places[values] = np.arange(len(values))
    keys = np.zeros(len(values), dtype=np.uint64)
    for k in range(ORDER):
        keys |= alphabet[values // a ** k % a].astype(np.uint64) << np.uint64(BITS * k)
    return keys, places[small]


def _losses(shared, alphabet):
    """Sums of the bits of each text's characters under each language, in the order of the languages' names, over the
    characters whose 4-grams lie in the slice."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, lo, hi = shared.value
        table = numbers(alphabet.value)
        for batch in batches:
            for rows, data, offsets in tx.text_pieces(batch, "_text"):
                n = rows.stop - rows.start
                grams, doc, letters = char_grams(data, offsets, table)
                keys, place = _distinct(grams)
                length = np.bincount(doc, minlength=n)
                middle = _middle(keys)
                own = (middle >= lo) & (middle < hi)
                out = np.empty((n, len(models)))
                for i, model in enumerate(models):
                    loss = np.zeros(len(keys))
                    loss[own] = -np.log2(model.probability(keys[own]))
                    out[:, i] = np.bincount(doc, weights=loss[place], minlength=n)
                part = batch.slice(rows.start, n)
                at = np.arange(n + 1, dtype=np.int32) * len(models)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names[:-1]), pa.array(letters, pa.int64()), pa.array(length, pa.int64()),
                     pa.ListArray.from_arrays(at, pa.array(out.ravel()))], names=[*part.schema.names[:-1], "n_letters", "n_chars", "loss"])

    return score


class LanguageModels:
    """Learned models of several languages: counts in a stored table, slices of the models sent to tasks when they score."""

    def __init__(self, learn: DataFrame, lang: str = "lang", text: str = "text", slice_grams: int = SLICE_GRAMS):
        """From all rows of ``learn`` with a language and a text."""
        self.spark = learn.sparkSession
        source = learn.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("_text"), F.lit(0).alias("doc"))
        source = source.filter("lang is not null and _text is not null")
        found = source.select("_text").mapInArrow(_alphabet, "code int").distinct().toArrow().column("code").to_numpy()
        self.alphabet = self.spark.sparkContext.broadcast(np.sort(found))
        numbers(self.alphabet.value)
        self.grams = materialize(source.mapInArrow(_count(self.alphabet), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
        orders = [None, None, None, self.grams]
        for k in (3, 2, 1):
            shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
            orders[k - 1] = materialize(orders[k].groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        tallies = [{r["lang"]: r for r in t.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), F.count_if(F.col("n") == 1).alias("once"),
                                                              F.count_if(F.col("n") == 2).alias("twice")).collect()} for t in orders]
        self.languages = sorted(tallies[3])
        if len(self.languages) > MAX_LANGUAGES:
            raise ValueError(f"{len(self.languages)} languages; {MAX_LANGUAGES} at most")
        self.discounts = [[_discount(t[x]["once"], t[x]["twice"]) for t in tallies] for x in self.languages]
        self.pairs = orders[1]
        self.singles = self._arrays(orders[0])
        held = sum(r["grams"] for r in tallies[3].values())
        slices = -(-held // slice_grams)
        cuts = []
        self.limits = [float("inf")] * len(self.languages)
        if slices > 1:
            # Quantiles of the middle characters, each the first number of a slice.
            cuts = self.grams.select(self._middle().cast("double").alias("m")).approxQuantile(
                "m", [i / slices for i in range(1, slices)], 0.1 / slices)
        edges = [0, *sorted({int(c) for c in cuts} - {0}), 1 << (2 * BITS)]
        self.slices = list(zip(edges[:-1], edges[1:], strict=True))
        self.only = self._slice(*self.slices[0]) if len(self.slices) == 1 and self.languages else None
        if self.languages:
            own = self._scores(source).withColumn("own", F.element_at("bits", F.array_position(self._names(), F.col("lang")).cast("int")))
            fit = {r["lang"]: r for r in own.filter("n_letters > 0").groupBy("lang").agg(
                F.avg("own").alias("mean"), F.stddev_pop("own").alias("spread")).collect()}
            self.limits = [fit[x]["mean"] + SPREADS * fit[x]["spread"] if x in fit else float("inf") for x in self.languages]

    def _names(self):
        return F.array(*[F.lit(x) for x in self.languages])

    @staticmethod
    def _middle():
        low = F.lit((1 << BITS) - 1)
        third, second = (F.shiftrightunsigned("gram", BITS * k).bitwiseAND(low) for k in (1, 2))
        return F.shiftleft(third, BITS).bitwiseOR(second)

    def _arrays(self, grams: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of each language."""
        if not self.languages:
            return []
        table = grams.select((F.array_position(self._names(), F.col("lang")) - 1).cast("int").alias("lang"), "gram", "n").toArrow()
        code, keys, n = (table.column(c).to_numpy() for c in ("lang", "gram", "n"))
        return [(keys[code == i].view(np.uint64), n[code == i]) for i in range(len(self.languages))]

    def _slice(self, lo: int, hi: int):
        """The models of one slice, sent out."""
        m, third = self._middle(), F.shiftrightunsigned("gram", BITS)
        grams = self._arrays(self.grams.filter((m >= lo) & (m < hi)))
        pairs = self._arrays(self.pairs.filter((third >= lo >> BITS) & (third <= (hi - 1) >> BITS)))
        models = [KneserNey(*parts) for parts in zip(self.singles, pairs, grams, self.discounts, strict=True)]
        return self.spark.sparkContext.broadcast((models, np.uint64(lo), np.uint64(hi)))

    def _scores(self, source: DataFrame) -> DataFrame:
        """doc, lang, n_letters, bits: cross-entropy per character under each language. With several slices the texts are
        read once for each, and only sums per distinct row are shuffled."""
        kinds = f"doc {dict(source.dtypes)['doc']}, lang string"
        sums = "n_letters bigint, n_chars bigint, loss array<double>"
        bits = F.transform("loss", lambda x: x / F.greatest("n_chars", F.lit(1))).alias("bits")
        if self.only:
            return source.select("doc", "lang", "_text").mapInArrow(_losses(self.only, self.alphabet), f"{kinds}, {sums}").select("doc", "lang", "n_letters", bits)
        keyed = source.select("doc", "lang", F.xxhash64("_text").alias("_a"), F.xxhash64(F.lit(1), "_text").alias("_b"), "_text")
        parts = None
        for lo, hi in self.slices:
            shared = self._slice(lo, hi)
            part = materialize(keyed.mapInArrow(_losses(shared, self.alphabet), f"{kinds}, _a bigint, _b bigint, {sums}"))
            shared.destroy()
            parts = part if parts is None else parts.unionByName(part)
        # Equal rows are summed together and divided again.
        total = [F.sum(F.col("loss")[i]) for i in range(len(self.languages))]
        added = parts.groupBy("doc", "lang", "_a", "_b").agg(
            F.max("n_letters").alias("n_letters"), F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("_rows"), F.array(*total).alias("loss"))
        copies = (F.col("_rows") / len(self.slices)).cast("bigint")
        added = added.withColumn("loss", F.transform("loss", lambda x: x / copies))
        return added.select(F.explode(F.array_repeat(F.struct("doc", "lang", "n_letters", bits), copies.cast("int"))).alias("r")).select("r.*")

    def identify(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per row of ``docs``: id, ``lang_pred``, ``score`` (share of the best language, from the differences in
        cross-entropy), ``bits`` (best cross-entropy per character) and ``accepted``.

        Texts that are null or have no letter are ``und``, score 0, not accepted. Of equal languages the first by name
        wins. Repeated rows each get their row. With no language learned, all is ``und``."""
        if not self.languages:
            return docs.select(doc_id, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                               F.lit(None).cast("double").alias("bits"), F.lit(False).alias("accepted"))
        scored = self._scores(docs.select(F.col(doc_id).alias("doc"), F.lit("").alias("lang"), F.col(text).cast("string").alias("_text")))
        best = F.array_position("bits", F.array_min("bits")).cast("int")
        share = 1 / F.aggregate(F.transform("bits", lambda b: F.exp(SHARPNESS * (F.array_min("bits") - b))), F.lit(0.0), lambda a, b: a + b)
        some = F.col("n_letters") > 0
        limit = F.element_at(F.array(*[F.lit(x) for x in self.limits]), best)
        return scored.select(F.col("doc").alias(doc_id), F.when(some, F.element_at(self._names(), best)).otherwise("und").alias("lang_pred"),
                             F.when(some, share).otherwise(0.0).alias("score"), F.when(some, F.array_min("bits")).alias("bits"),
                             (some & (F.array_min("bits") <= limit)).alias("accepted"))
