"""Quality rules by repetition coverage: how many characters lie in n-grams or lines that a text repeats.

For each n-gram length, rolling hashes of all windows of a text are sorted within the text and equal neighbours mark
their words. Short lengths (2 to 4) measure the one most frequent n-gram, long ones (5 to 10) all repeated ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

REPEAT_WINDOW = 8
#: Largest shares of word characters that a kept text may have: in the repeated n-gram that covers most, in all repeated n-grams
#: (only texts of MIN_WORDS words or more are judged), in repeated lines; and of repeated lines among its lines.
TOP_GRAM = {2: 0.20, 3: 0.18, 4: 0.16}
ALL_GRAMS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_CHARS, LINE_COUNT = 0.30, 0.30
MIN_WORDS = 50
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, "
          "dup_line_chars bigint, " + ", ".join(f"top_{n}gram_chars bigint" for n in TOP_GRAM) + ", "
          + ", ".join(f"dup_{n}gram_chars bigint" for n in ALL_GRAMS))


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the words first[d]..first[d + 1] of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by (text, hash), and where runs of equal windows start in it. Windows come in text order, so one sort
    by a hash that holds the text is enough."""
    key = tx.mix(h ^ tx.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _measure(words: tx.Words) -> dict[str, np.ndarray]:
    n_docs, n = len(words.first) - 1, len(words.starts)
    doc, counts, h = words.doc_of_words(), words.counts(), words.hashes()
    letters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int64)])
    chars = letters[words.ends] - letters[words.starts]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[words.data], dtype=np.int64)])
    out = {"n_words": counts, "word_chars": _per_text(chars, words.first),
           "n_symbols": symbols[words.offsets[1:]] - symbols[words.offsets[:-1]]}
    char_at = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])

    def grams(size: int):
        m = n - size + 1
        if m <= 0:
            return None
        fits = np.flatnonzero(doc[:m] == doc[size - 1:])
        if not len(fits):
            return None
        order, run = _runs(tx.windows(h, size)[fits], doc[fits])
        return fits[order], run, np.diff(np.append(run, len(order)))

    def covered(size: int) -> np.ndarray:
        """Words inside windows that occur more than once in their text."""
        found = grams(size)
        mark = np.zeros(n, dtype=bool)
        if found is not None:
            at, _, length = found
            mark[at[np.repeat(length > 1, length)]] = True
        return tx.in_windows(mark, size)

    repeated = {size: covered(size) for size in sorted({REPEAT_WINDOW, *ALL_GRAMS})}
    out["n_repeat_words"] = _per_text(repeated[REPEAT_WINDOW], words.first)
    for size in ALL_GRAMS:
        out[f"dup_{size}gram_chars"] = _per_text(np.where(repeated[size], chars, 0), words.first)
    for size in TOP_GRAM:
        best = np.zeros(n_docs, dtype=np.int64)
        found = grams(size)
        if found is not None:
            # Copies of one n-gram come in text order; each adds the words that the one before it has not covered.
            at, run, length = found
            fresh = at.copy()
            fresh[1:] = np.maximum(at[1:], at[:-1] + size)
            fresh[run] = at[run]
            cover = np.add.reduceat(char_at[at + size] - char_at[fresh], run)
            np.maximum.at(best, doc[at[run]], np.where(length > 1, cover, 0))
        out[f"top_{size}gram_chars"] = best

    # Lines: cut at line feeds and where a text ends; a line counts if a word starts in it.
    feeds = np.flatnonzero(words.data == 0x0A)
    owner = np.searchsorted(words.offsets, feeds, side="right") - 1
    begins = np.sort(np.concatenate([words.offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([words.offsets[1:], feeds]), kind="stable")
    lines = np.bincount(owner, minlength=n_docs) + 1 if n_docs else np.empty(0, np.int64)
    of = np.repeat(np.arange(n_docs), lines)
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    begins, ends, of = begins[filled], ends[filled], of[filled]
    whole = tx.Words(words.data, words.offsets, begins, ends, np.searchsorted(of, np.arange(n_docs + 1)), words.fold)
    again = np.zeros(len(begins), dtype=bool)
    if len(begins):
        order, run = _runs(whole.hashes(), of)
        again[order] = True
        again[order[run]] = False
    line_chars = char_at[np.searchsorted(words.starts, ends)] - char_at[np.searchsorted(words.starts, begins)]
    out |= {"n_lines": np.bincount(of, minlength=n_docs), "n_dup_lines": np.bincount(of[again], minlength=n_docs),
            "dup_line_chars": np.bincount(of[again], weights=line_chars[again], minlength=n_docs).astype(np.int64)}
    return out


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the measures of ``SCHEMA``. Texts are measured whole, one pass, no shuffle.
    Null counts as an empty text; an empty text has zeros. Repeated rows and ids each get their row."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tx.text_pieces(batch, "_text", tx.BLOCK):
                found = _measure(tx.split_words(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").slice(rows.start, rows.stop - rows.start)]
                    + [pa.array(found[c], pa.int64()) for c in names], names=["_doc", *names])

    source = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text"))
    kind = dict(source.dtypes)["_doc"]
    return source.mapInArrow(measure, f"_doc {kind}, {SCHEMA}").withColumnRenamed("_doc", doc_id)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``repetition`` with ``base_failed``, ``failed`` (names of the rules of this method that a text breaks) and ``kept``.
    Texts with fewer than MIN_WORDS words are judged by lines only: in so few words one repeat is a large share."""
    m = repetition(docs, doc_id, text)
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    long_enough = F.col("n_words") >= MIN_WORDS
    rules = {f"top_{n}gram": long_enough & (F.col(f"top_{n}gram_chars") / chars > most) for n, most in TOP_GRAM.items()}
    rules |= {f"dup_{n}gram": long_enough & (F.col(f"dup_{n}gram_chars") / chars > most) for n, most in ALL_GRAMS.items()}
    rules["line_chars"] = F.col("dup_line_chars") / chars > LINE_CHARS
    rules["line_count"] = F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)) > LINE_COUNT
    failed = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (m.withColumn("base_failed", base).withColumn("failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))
