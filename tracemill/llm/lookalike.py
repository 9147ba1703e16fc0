"""Visually identical text with different characters.

Method: a text is exploded to positioned code points; a broadcast table of decompositions and
look-alikes is joined to them; combining marks are ordered by class, recomposed, and the string rebuilt.

The explosion happens inside an Arrow batch, as one flat array of code points with their rows, so it
costs no shuffle and no row per character. The table is made from Python's Unicode data by rule and
holds only the code points that change: its size is bounded by Unicode, not by the data.
"""

from __future__ import annotations

import sys
import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracemill.runtime import Scratch

# Letters of other alphabets whose usual shape is that of a Latin letter.
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    # Greek
    "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "յ": "j", "ց": "g", "Օ": "O", "Ս": "U",
    # Latin letters of phonetic script
    "ɑ": "a", "ɡ": "g", "ı": "i",
}
# Signs that show nothing although their class is not control or format.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
#: Kinds of decomposition that change width or join letters, not meaning or size.
FORMS = ("<wide>", "<narrow>", "<noBreak>")


def _pieces(c: str) -> str:
    """What one character becomes, before marks are ordered: '' if it is invisible."""
    cp, category = ord(c), ud.category(c)
    if c == "\t" or category == "Zs" or c == "⠀":
        return " "
    if category == "Cf" or (category == "Cc" and c not in "\n\r\x0b\x0c\x85") or c in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    how = ud.decomposition(c)
    if not how:
        return ud.normalize("NFD", c) if 0xAC00 <= cp <= 0xD7A3 else LOOK_ALIKE.get(c, c)
    kind, _, rest = how.partition(" ") if how.startswith("<") else ("", "", how)
    if kind and kind not in FORMS and not (kind == "<compat>" and ("LIGATURE" in ud.name(c, "") or c == "µ")):
        return LOOK_ALIKE.get(c, c)
    return "".join(_pieces(chr(int(x, 16))) for x in rest.split())


class Tables:
    """Arrays of changed code points, of combining classes and of compositions."""

    def __init__(self):
        changed, counts, flat, marks, classes, pairs, whole = [], [], [], [], [], [], []
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if ud.category(c) in ("Cn", "Co", "Cs"):
                continue
            if (to := _pieces(c)) != c:
                changed.append(cp)
                counts.append(len(to))
                flat.extend(map(ord, to))
            if n := ud.combining(c):
                marks.append(cp)
                classes.append(n)
            how = ud.decomposition(c)
            if how and how[0] != "<" and len(two := how.split()) == 2 and ud.normalize("NFC", c) == c and ud.combining(chr(int(two[1], 16))):
                pairs.append(int(two[0], 16) << 21 | int(two[1], 16))
                whole.append(cp)
        order = np.argsort(pairs)
        self.changed, self.counts, self.flat = np.array(changed), np.array(counts), np.array(flat, np.uint32)
        self.marks, self.classes = np.array(marks), np.array(classes)
        self.pairs, self.whole = np.array(pairs)[order], np.array(whole, np.uint32)[order]

    def by_code(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By code point: how many it becomes, where those stand; the pieces; its combining class."""
        n = sys.maxunicode + 1
        counts, starts, classes = np.ones(n, np.int64), np.arange(n), np.zeros(n, np.uint8)
        counts[self.changed] = self.counts
        starts[self.changed] = n + np.cumsum(self.counts) - self.counts
        classes[self.marks] = self.classes
        return counts, starts, np.concatenate([np.arange(n, dtype=np.uint32), self.flat]), classes


class Unifier:
    def __init__(self, tables: Tables):
        self.tables = tables
        self.counts, self.starts, self.pieces, self.classes = tables.by_code()

    def __call__(self, texts: list[str | None]) -> list[str | None]:
        """Each text in its one form; null stays null. Texts of printable ASCII are in it already."""
        at = [i for i, t in enumerate(texts) if t and not (t.isascii() and t.isprintable())]
        if not at:
            return list(texts)
        lengths = np.array([len(texts[i]) for i in at])
        codes = np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(at)), lengths)
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        codes = self.pieces[np.repeat(self.starts[codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        row = np.repeat(row, counts)
        codes, row = self._compose(*self._ordered(codes, row))
        whole = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.bincount(row, minlength=len(at)))
        out = list(texts)
        start = 0
        for i, end in zip(at, ends.tolist()):
            out[i] = whole[start:end]
            start = end
        return out

    def _ordered(self, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks after one letter in the order of their classes, those of one class as they stood."""
        classes = self.classes[codes].astype(np.int64)
        if len(codes) > 1 and ((classes[1:] > 0) & (classes[:-1] > classes[1:]) & (row[1:] == row[:-1])).any():
            new = classes == 0
            new[0] = True
            new[1:] |= row[1:] != row[:-1]
            order = np.argsort(np.cumsum(new) * 256 + classes, kind="stable")
            codes, row = codes[order], row[order]
        return codes, row

    def _compose(self, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letter and mark become one code point wherever one exists; a mark behind another of its class is blocked."""
        classes = self.classes[codes]
        marks = np.flatnonzero(classes)
        if not len(marks):
            return codes, row
        codes = codes.copy()
        letters = np.flatnonzero(classes == 0)
        nth = np.searchsorted(letters, marks) - 1
        letter = np.where(nth >= 0, letters[np.maximum(nth, 0)] if len(letters) else -1, -1)
        good = (letter >= 0) & (row[letter] == row[marks])
        marks, letter = marks[good], letter[good]
        behind = np.zeros(len(codes), np.uint8)
        gone = np.zeros(len(codes), bool)
        depth = marks - letter
        order = np.argsort(depth, kind="stable")
        marks, letter, depth = marks[order], letter[order], depth[order]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for m, at in zip(np.split(marks, cuts), np.split(letter, cuts)):
            key = codes[at].astype(np.int64) << 21 | codes[m].astype(np.int64)
            k = np.minimum(np.searchsorted(self.tables.pairs, key), len(self.tables.pairs) - 1)
            fits = (self.tables.pairs[k] == key) & (behind[at] < classes[m])
            codes[at[fits]] = self.tables.whole[k[fits]]
            gone[m[fits]] = True
            behind[at[~fits]] = classes[m[~fits]]
        return codes[~gone], row[~gone]


_LOCAL: dict[str, Unifier] = {}


def _unifier(tables) -> Unifier:
    """One a worker process: the tables by code point are made on first use."""
    if "one" not in _LOCAL:
        _LOCAL["one"] = Unifier(tables.value)
    return _LOCAL["one"]


def unify(df: DataFrame, column: str, into: str) -> DataFrame:
    """df with the column's texts in one form in column ``into`` (which must be a new name); null stays null."""
    if into in df.columns:
        raise ValueError(f"{into} is a column already")
    tables = df.sparkSession.sparkContext.broadcast(Tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _unifier(tables)
        for batch in batches:
            yield batch.append_column(into, pa.array(one(batch.column(column).to_pylist()), pa.string()))

    schema = df.select("*", F.lit("").cast("string").alias(into)).schema
    schema[into].nullable = True
    return df.mapInArrow(run, schema)


def same_looking_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key_a, key_b), a < b: every two records whose strings differ but have one form.

    Null keys, null texts and texts with nothing visible count for nothing; rows of one key are one record;
    an empty table gives an empty result. Only 128-bit digests of forms and strings are shuffled, and only
    forms that stand in several strings reach the join, whose skewed keys AQE splits.
    """
    scratch = Scratch(df.sparkSession, "lookalike")
    tables = df.sparkSession.sparkContext.broadcast(Tables())
    schema = pa.schema([("key", pa.int64()), ("form", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, digest = _unifier(tables), xxhash.xxh3_128_digest
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys, forms, raws = [], [], []
            for k, t, form in zip(batch.column(0).to_pylist(), texts, one(texts)):
                if form and not form.isspace():
                    keys.append(k)
                    forms.append(digest(form.encode("utf-8", "surrogatepass")))
                    raws.append(digest(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], schema=schema)

    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    rows = scratch.keep(rows.mapInArrow(run, "key long, form binary, raw binary"))
    mixed = rows.groupBy("form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("form")
    rows = scratch.keep(rows.join(mixed, "form", "left_semi").distinct())
    a, b = (rows.select("form", F.col("key").alias(f"key_{x}"), F.col("raw").alias(f"raw_{x}")) for x in "ab")
    return a.join(b, "form").where("key_a < key_b and raw_a <> raw_b").select("key_a", "key_b").distinct()
