"""Line dedup in DataFrame functions only: which lines of each document go because other documents have them too.

Hashes of line keys are range-partitioned and sorted by (hash, salt, document descending, position). The first row of a
document inside a key is its first occurrence; counting those and taking the largest id gives each key's documents and
its keeper. A key held by a third of all documents is spread by a salt of its document, so no task gets it whole, and
only its partial counts meet. What comes back is a bitmap per document that loses lines, never its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import materialize

#: Parts into which one key's documents are dealt for sorting, and for the join with the key's verdict (64 bits of a mask).
SALTS, SLOTS = 4096, 64
#: What is stripped from the ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _body(text: Column) -> Column:
    return F.xxhash64(text)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc``, ``body`` (hash of the text), ``n_dropped``, ``keep``: one row for each document that loses lines.

    A key (see ``line_key``) of at least ``min_chars`` code points that at least ``min_docs`` ids hold loses all its lines
    but those of the largest id. ``keep`` is a bitmap in 64-bit words, bit ``i % 64`` of word ``i / 64`` for line ``i``
    from 0; words after the last one that drops a line are left out and keep everything. Keys are compared by 128-bit
    hashes. Repeated rows of one id count as one document and lose or keep the same lines; rows of one id with different
    texts are told apart by ``body``. Rows without id are neither counted nor cut. Null and empty texts have no key.
    An empty table gives no rows; other columns of ``docs`` do not matter. Runs a job while the plan is built."""
    source = docs.select(F.col(doc_id).alias("doc"), _body(F.col(text)).alias("body"), F.col(text).alias("_text"))
    found = (source.filter(F.col("doc").isNotNull() & (F.octet_length("_text") >= min_chars))
             .select("doc", "body", F.posexplode(split_lines(F.col("_text"))).alias("pos", "line"))
             .filter(F.octet_length("line") >= min_chars)
             .select("doc", "body", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars))
    # Stored, as sorting by range reads its input twice: once for the bounds.
    rows = materialize(found.select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
                                    F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")))
    ranged = rows.repartitionByRange("h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc"), "body", "pos")
    marked = ranged.withColumn("first", F.coalesce(F.lag("doc").over(order) != F.col("doc"), F.lit(True)))
    slot = F.pmod("salt", F.lit(SLOTS))
    keys = (marked.groupBy("h1", "h2")
            .agg(F.sum(F.col("first").cast("bigint")).alias("n_docs"), F.max("doc").alias("last"),
                 F.bit_or(F.expr(f"shiftleft(1L, salt % {SLOTS})")).alias("slots"))
            .filter(F.col("n_docs") >= min_docs)
            .select("h1", "h2", "last", F.explode(F.expr(
                f"filter(sequence(0, {SLOTS - 1}), s -> (shiftrightunsigned(slots, s) & 1) = 1)")).alias("slot")))
    dropped = (ranged.withColumn("slot", slot).join(keys, ["h1", "h2", "slot"]).filter(F.col("doc") < F.col("last"))
               .select("doc", "body", F.shiftright("pos", 6).alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit")))
    words = dropped.groupBy("doc", "body", "word").agg(F.bit_or("bit").alias("bits"))
    # At most one entry per 64 lines of the document itself.
    packed = words.groupBy("doc", "body").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
                                              F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    keep = F.aggregate("bits", F.expr("cast(array() as array<bigint>)"), lambda have, x: F.concat(
        have, F.array_repeat(F.lit(-1).cast("bigint"), x["word"] - F.size(have)), F.array(F.bitwise_not(x["bits"]))))
    return packed.select("doc", "body", "n_dropped", keep.alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap of ``line_dedup`` keeps, joined; a null bitmap keeps all."""
    def stays(_, i):
        word = F.coalesce(F.get(keep, F.shiftright(i, 6)), F.lit(-1).cast("bigint"))
        return F.call_function("shiftright", word, i % 64).bitwiseAND(F.lit(1)) == 1

    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(split_lines(text), stays), "\n"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text",
               carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, the columns ``carry``, ``n_lines`` (before dropping), ``n_dropped``, ``kept_text``.
    Texts are sent once, to their bitmaps; the bitmaps of a partition are the hashed side, texts are not sorted."""
    left = docs.select(F.struct(doc_id, *carry).alias("_row"), F.col(doc_id).alias("doc"), _body(F.col(text)).alias("body"),
                       F.col(text).alias("_text"))
    both = left.join(bitmaps.hint("shuffle_hash"), ["doc", "body"], "left")
    return both.select("_row.*", F.size(split_lines(F.col("_text"))).cast("bigint").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
                       kept_text(F.col("_text"), F.col("keep")).alias("kept_text"))
