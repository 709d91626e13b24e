"""Fill-in-the-middle: texts cut at two ranks and written in the order a model learns to fill gaps from.

The units of a text (code points, or matches of a pattern) are kept in an indexable skip list. Every lane's nodes carry
how many units and how many code points they span; a descent from the top lane adds widths up to the wanted rank and so
reaches its code point without counting from the start."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
#: Shares of a hundred: texts left plain, and texts with the suffix first among those cut.
PLAIN, SPM = 10, 20
#: A node of a lane is a node of the next lane too with a chance of one in 2**LIFT, so a lane steps over 8 nodes at a time.
LIFT = 3
#: A unit's height is read off these random bits, so that the same text gives the same list everywhere.
_heights = np.random.Generator(np.random.PCG64(71)).integers(0, 2**63, 1 << 16, dtype=np.int64)


class SkipList:
    """Units of one text, by their numbers of code points.

    ``units[k]`` and ``points[k]`` are the widths of lane k's nodes in units and in code points; ``down[k]`` is where each
    node of lane k stands in lane k - 1. The head is the first node of every lane."""

    def __init__(self, lengths: np.ndarray):
        n = len(lengths)
        self.n, self.total = n, int(lengths.sum())
        self.units, self.points, self.down = [np.ones(n, np.int64)], [lengths.astype(np.int64)], [np.arange(n)]
        bits = np.resize(_heights, n)
        while len(bits) > 1 << LIFT:
            up = bits & ((1 << LIFT) - 1) == 0
            up[0] = True
            at = np.flatnonzero(up)
            if len(at) == len(bits):
                break
            self.units.append(np.add.reduceat(self.units[-1], at))
            self.points.append(np.add.reduceat(self.points[-1], at))
            self.down.append(at)
            bits = bits[at] >> LIFT

    def point(self, rank: int) -> int:
        """Code points before the unit of this rank (``n`` for the end)."""
        if rank >= self.n:
            return self.total
        seen = points = node = 0
        for lane in range(len(self.units) - 1, -1, -1):
            units = self.units[lane]
            while node < len(units) and seen + units[node] <= rank:
                seen += int(units[node])
                points += int(self.points[lane][node])
                node += 1
            if seen == rank:
                break
            if lane:
                node = self.down[lane][node]
        return points


def unit_lengths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Code points of each unit, in text order. What lies between two matches belongs to the one that follows, what is left
    at the end is a unit of its own, so the lengths always add up to the text. Empty matches are no units."""
    if unit is None:
        return np.ones(len(text), dtype=np.int64)
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array([0, *ends], dtype=np.int64))


def draws(key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the hash of a key."""
    digest = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def cut(text: str, key: str, unit: re.Pattern | None = None, plain: int = PLAIN, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    lengths = unit_lengths(text, unit)
    n = len(lengths)
    h1, h2, h3, h4 = draws(key)
    if not n or MARKS.search(text) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    lanes = SkipList(lengths)
    a, b = sorted((lanes.point(h1 % (n + 1)), lanes.point(h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", epoch: int = 1, unit: str | None = None,
                   plain: int = PLAIN, spm: int = SPM, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, the columns ``carry``, then ``n`` (units), ``form`` (plain, psm or spm),
    ``prefix_chars`` and ``middle_chars`` (code points; null if plain), ``output``.

    Units are code points, or the matches of the pattern ``unit``. ``plain`` percent of the texts stay as they are, ``spm``
    percent of the others get their suffix first. Cuts hang on ``epoch`` and id alone, so repeated rows are cut alike and a
    repeated task gives the same rows; a null id counts as the word null. Null and empty texts, and texts that hold one of
    the marks, stay plain. Whole texts are cut; each task works text by text, so memory follows the longest one."""
    pattern = re.compile(unit, re.DOTALL) if unit else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            bodies = batch.column("_text").cast(pa.large_binary())
            others = [(i, name) for i, name in enumerate(batch.schema.names) if name not in ("_key", "_text")]
            start = 0
            while start < len(keys):
                rows, held, stop = [], 0, start
                while stop < len(keys) and held < 1 << 22:
                    # Bytes that are no UTF-8 count as single code points.
                    body = (bodies[stop].as_py() or b"").decode("utf-8", "surrogateescape")
                    rows.append(cut(body, keys[stop], pattern, plain, spm))
                    held += len(body)
                    stop += 1
                n, form, prefix, middle, output = zip(*rows, strict=True)
                outputs = pa.array([x.encode("utf-8", "surrogateescape") for x in output], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(start, stop - start) for i, _ in others]
                    + [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), outputs],
                    names=[*(name for _, name in others), "n", "form", "prefix_chars", "middle_chars", "output"])
                start = stop

    source = docs.select(F.struct(doc_id, *carry).alias("_row"),
                         F.concat(F.lit(f"{epoch}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).alias("_key"),
                         F.col(text).cast("string").alias("_text"))
    row = source.schema["_row"].dataType.simpleString()
    done = source.mapInArrow(apply, f"_row {row}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return done.select("_row.*", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form. Parts hold no marks, so the first of each mark is the one put in."""
    def part(source: Column, mark: str, number: int) -> Column:
        return F.split_part(source, F.lit(mark), F.lit(number))  # compares bytes, unlike a pattern

    middle = part(output, MIDDLE, 2)
    psm = F.concat(part(part(output, PREFIX, 2), SUFFIX, 1), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
