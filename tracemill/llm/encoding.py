"""Garbled text from wrong character encoding.

Method: minimum description length. Every candidate decoding of a passage is compressed with zstandard
dictionaries, one a language; the chain of decodings whose best compression plus the cost of the chain is
smallest wins, and where no chain beats the text as it stands, it stays unchanged.

The dictionaries and the known letter pairs are fitted on all labelled texts: pairs are counted over all of them, and
each part of a few hundred texts gives a dictionary, from which the language's one is trained. Detection covers every
document whole. Texts of plain ASCII are decided without work. A letter
pair that a language doesn't show costs some bytes in that language, on top of the compression, and a passage takes
the language that is cheapest for it as a whole. So a passage whose pairs one language shows throughout, and in
which no run of characters decodes as UTF-8, has nothing to gain; every other passage is decided by length, under
each chain that leaves fewer pairs unexplained. Only letters of Latin, Greek and Cyrillic alphabets are restored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tracemill.runtime import Scratch, delete

LANGUAGES = ("en", "de", "fr", "es", "pt", "pl", "ru", "el")
#: Texts of a part, about, and dictionaries that one is trained from.
PART, FAN_IN = 500, 64
#: Bytes of a dictionary, and of the pieces into which others' are cut to train it.
DICTIONARY_BYTES, PIECE = 24_000, 400
#: A pair is known to a language when two of its texts have it, and one in so many.
RARE = 1_000

#: Encodings a reader may have used for UTF-8 bytes, and for or instead of another single-byte encoding.
WRONG = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp1253", "cp866", "koi8_r", "iso8859_2")
RIGHT = ("cp1252", "cp1250", "cp1251", "cp1253", "iso8859_2", "iso8859_5", "iso8859_7", "koi8_r", "mac_roman", "cp437", "cp850", "cp866")
#: Bytes that each step of a chain costs, to UTF-8 and to another single-byte encoding, and a pair that the language doesn't show.
STEP_UTF8, STEP_SINGLE, PAIR = 1, 2, 3
DEPTH = 3

RUN = re.compile(r"[^\x00-\x7f]+")
#: Characters outside ASCII with what stands beside them, a blank at a word's end included.
STRETCH = re.compile(r"(?:[\x20-\x7e]?[^\x00-\x7f]+)+[\x20-\x7e]?")
PASSAGE = re.compile(r"[^\n.!?…]*(?:[.!?…]+[”\"»“’)]*(?:\s+|$)|\n|[.!?…]|$)")
CONTROL = re.compile(r"[\x80-\x9f]")
#: Lower-cased lead characters of garbled sequences, and what they were.
RAISED = str.maketrans("ãåäðñîïíìë", "ÃÅÄÐÑÎÏÍÌË")


def common(c: str) -> bool:
    """Letters of the modern Latin, Greek and Cyrillic alphabets, general punctuation and signs."""
    n = ord(c)
    return 0xA0 <= n <= 0x17F or 0x386 <= n <= 0x3CE or n in (0x401, 0x451) or 0x410 <= n <= 0x44F or 0x2010 <= n <= 0x203A or n in (0x20AC, 0x2122, 0x2030) or n < 0x80


def encoded(text: str, encoding: str) -> bytes | None:
    """The bytes that this encoding shows as text; bytes it doesn't define stand as C1 controls in cp125x."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125") or not CONTROL.search(text):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


def utf8_chains(run: str, folded: bool, depth: int = DEPTH) -> list[tuple[tuple[str, ...], str]]:
    """(chain, text) of every way in which a whole run of characters outside ASCII is garbled UTF-8 of common characters."""
    out = []
    for wrong in WRONG:
        for start, kind in [(run, wrong)] + ([(run.translate(RAISED), f"lower {wrong}")] if folded and run != run.translate(RAISED) else []):
            # Latin-1 is cp1252 where that defines no character.
            b = encoded(start, wrong)
            if b is None:
                continue
            try:
                text = b.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(text) < len(run):
                inner = utf8_chains(text, folded, depth - 1) if depth > 1 and not text.isascii() else []
                out += [((kind, *chain), last) for chain, last in inner]
                if all(map(common, text)):
                    out.append(((kind,), text))
    return out


def pairs_of(stretch: str) -> Iterator[str]:
    """Neighbouring characters of which at least one is outside ASCII. Signs beside blanks, digits and punctuation
    are left out: a sign of any kind may stand by itself, a letter may not."""
    for a, b in zip(stretch, stretch[1:]):
        if a > "\x7f":
            if b > "\x7f" or b.isalpha() or a.isalpha():
                yield a + b
        elif b > "\x7f" and (a.isalpha() or b.isalpha()):
            yield a + b


ACCENTED = re.compile(r"[À-ÿ]")
LETTER = re.compile(r"[^\W\d_]")
#: Every ``ODD`` holds one.
SIGN = re.compile(r"[¹²³¿¯¸·£¥А-ЯЁ]")
ODD = re.compile(r"[^\W\d_][¹²³¿¯¸·£¥][^\W\d_]|[а-яё][А-ЯЁ]")


@lru_cache(100_000)
def _decodes(run: str) -> bool:
    return bool(utf8_chains(run, True, 1))


@lru_cache(100_000)
def _pairs(stretch: str) -> frozenset[str]:
    return frozenset(pairs_of(stretch))


def natural(text: str) -> bool:
    """Whether a text can serve as a sample: no lost or control characters, nothing that decodes, no writing in
    which two letters of five are accented, signs stand within words, or capitals follow small Cyrillic letters."""
    runs = RUN.findall(text)
    strange = "".join(runs)
    if "�" in strange or CONTROL.search(strange) or SIGN.search(strange) and len(ODD.findall(text)) > 1:
        return False
    # Passages of over 15 letters count, so seven are accented at least.
    if len(ACCENTED.findall(strange)) > 6:
        for p in PASSAGE.findall(text):
            accented = len(ACCENTED.findall(p))
            if accented > 6 and 15 < len(LETTER.findall(p)) < accented / 0.4:
                return False
    return not any(len(r) > 1 and _decodes(r) for r in set(runs))


def single_chains() -> list[tuple[str, dict[int, str]]]:
    """(name, character to character) of every way to have read one single-byte encoding as another."""
    out = []
    for wrong in WRONG:
        for right in RIGHT:
            if right != wrong:
                table = {}
                for n in range(0x80, 0x100):
                    b = bytes([n])
                    shown = b.decode(wrong, "ignore") or (chr(n) if wrong.startswith("cp125") and n < 0xA0 else "")
                    meant = b.decode(right, "ignore")
                    if shown and meant and common(meant):
                        table[ord(shown)] = meant
                out.append((f"{wrong} for {right}", table))
    return out


class Detector:
    """Holds the dictionaries and each language's known pairs; ``decide`` gives a text's verdict."""

    def __init__(self, dictionaries: list[bytes], known: list[set[str]]):
        self.known: dict[str, int] = {}
        self.languages = max(1, len(known))
        for i, pairs in enumerate(known):
            for p in pairs:
                self.known[p] = self.known.get(p, 0) | 1 << i
        self.compressors = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=3)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.singles = single_chains()
        self.seen: dict[str, tuple[np.ndarray, bool]] = {}
        self.chains: dict[tuple[str, bool], list] = {}
        self.shifts: dict[str, np.ndarray] = {}

    def unknown(self, stretch: str) -> np.ndarray:
        """How many pairs of a stretch each language doesn't show."""
        out = np.zeros(self.languages, np.int32)
        for p in pairs_of(stretch):
            mask = self.known.get(p, 0)
            out += [not mask >> i & 1 for i in range(self.languages)]
        return out

    def look(self, stretch: str) -> tuple[np.ndarray, bool]:
        """(unknown pairs by language, whether a run in it decodes), remembered."""
        if stretch not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
                self.chains.clear()
            self.seen[stretch] = (self.unknown(stretch), any(self.ways(r, True) for r in RUN.findall(stretch)))
        return self.seen[stretch]

    def shifted(self, stretch: str) -> np.ndarray:
        """Unknown pairs of a stretch under each single-byte chain, by language; many where the chain can't be."""
        if stretch not in self.shifts:
            if len(self.shifts) > 20_000:
                self.shifts.clear()
            out = np.full((len(self.singles), self.languages), 10_000, np.int32)
            strange = {ord(c) for c in stretch if c > "\x7f"}
            for k, (_, table) in enumerate(self.singles):
                if table.keys() >= strange:
                    out[k] = self.unknown(stretch.translate(table))
            self.shifts[stretch] = out
        return self.shifts[stretch]

    def ways(self, run: str, folded: bool) -> list:
        """Chains that end in UTF-8; one character alone is none of them, as it takes two bytes at least."""
        if len(run) < 2:
            return []
        if (run, folded) not in self.chains:
            self.chains[run, folded] = utf8_chains(run, folded)
        return self.chains[run, folded]

    def strangeness(self, text: str) -> int:
        """Unknown pairs in the language that explains the text best."""
        found = STRETCH.findall(text)
        return int(sum(self.look(s)[0] for s in found).min()) if found else 0

    def length(self, text: str) -> int:
        """Bytes of the best compression, and those of unknown pairs."""
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self.compressors) + PAIR * self.strangeness(text)

    def passage(self, text: str, folded: bool) -> tuple[str, tuple[str, ...]]:
        """The passage as it should be, and the chain that led there: none if it stands."""
        stretches = STRETCH.findall(text)
        looks = [self.look(s) for s in stretches]
        strange = int(sum(n for n, _ in looks).min()) if looks else 0
        if not strange and not any(decodes for _, decodes in looks):
            return text, ()
        best, cost, chain = text, self.length(text), ()
        runs = set(RUN.findall(text))
        for way in sorted({c for r in runs for c, _ in self.ways(r, folded)}):
            to = {r: dict(self.ways(r, folded)).get(way, r) for r in runs}
            fixed = RUN.sub(lambda m: to[m.group()], text)
            # A run under one chain may leave others to a second one: passages of mixed garbling are mended in turn.
            n = self.length(fixed) + STEP_UTF8 * len(way) + 3 * sum(k.startswith("lower") for k in way)
            if n < cost:
                best, cost, chain = fixed, n, way
        if not chain and strange:
            left = sum(self.shifted(s) for s in stretches).min(axis=1)
            tried: set[str] = set()
            for k in np.flatnonzero(left < strange).tolist():
                name, table = self.singles[k]
                fixed = text.translate(table)
                if fixed not in tried:
                    tried.add(fixed)
                    n = self.length(fixed) + STEP_SINGLE
                    if n < cost:
                        best, cost, chain = fixed, n, (name,)
        return best, chain

    def decide(self, text: str | None) -> tuple[bool, str | None, list[str]]:
        """(garbled, restored text or null where nothing could be restored, chains used)."""
        if not text or text.isascii():
            return False, None, []
        looks = [self.look(s) for s in STRETCH.findall(text)]
        lost = "\ufffd" in text
        if not lost and not any(decodes for _, decodes in looks) and not sum(n for n, _ in looks).min():
            return False, None, []  # one language explains the whole text, and so each passage
        out, chains = [], []
        for m in PASSAGE.finditer(text):
            part = m.group()
            if part and not part.isascii():
                folded = part == part.lower()
                for _ in range(2 * DEPTH):
                    part, chain = self.passage(part, folded)
                    if not chain:
                        break
                    chains.append(" > ".join(chain))
            out.append(part)
        fixed = "".join(out)
        return lost or bool(chains), fixed if chains else None, sorted(set(chains))


def _trained(samples: list[bytes]) -> bytes | None:
    """A dictionary; None where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def _joined(dictionaries: list[bytes]) -> bytes:
    """One dictionary in place of several."""
    dictionaries = sorted(dictionaries)
    if len(dictionaries) == 1:
        return dictionaries[0]
    return _trained([d[i : i + PIECE] for d in dictionaries for i in range(0, len(d), PIECE)]) or dictionaries[0]


def _part(table: pa.Table) -> pa.Table:
    """(lang, n, dictionary, pairs, counts) of a part's texts, those with garbled stretches left out: their number,
    their dictionary or null, and how many of them show each letter pair."""
    clean = sorted(t for t in table.column("text").to_pylist() if natural(t))
    counts = Counter(p for t in clean for p in {p for s in STRETCH.findall(t) for p in _pairs(s)})
    dictionary = _trained([p.encode("utf-8", "surrogatepass") for t in clean for p in PASSAGE.findall(t) if len(p) > 8])
    columns = [table.column("lang")[:1].combine_chunks(), pa.array([len(clean)], pa.int64()), pa.array([dictionary], pa.binary()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, ["lang", "n", "dictionary", "pairs", "counts"])


def _merge(table: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([table.column("lang")[:1], pa.array([_joined(table.column("dictionary").to_pylist())], pa.binary())], ["lang", "dictionary"])


def fit(documents: DataFrame, *, key: str = "doc_id", text: str = "text", language: str = "lang", languages: tuple[str, ...] = LANGUAGES, part: int = PART, fan_in: int = FAN_IN) -> tuple[list[bytes], list[set[str]]]:
    """(dictionaries, each language's known letter pairs) from all texts labelled with a language, those with garbled stretches left out.

    Texts fall into parts by a hash of key and text, and are sorted there, so the fit is the same however the table
    is split. A language without texts, or with too few to train on, gets no dictionary; there is always one at least.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col(text).isNotNull() & F.col(language).isin(*languages)).select(F.col(language).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("at"))
    parts = {r.lang: -(-r.n // part) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not parts:
        return [b""], [set() for _ in languages]
    scratch = Scratch(spark, "encodings")
    of = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))[F.col("lang")]
    found = rows.select("lang", "text", F.pmod("at", of).alias("part")).groupBy("lang", "part").applyInArrow(_part, "lang string, n long, dictionary binary, pairs array<string>, counts array<long>")
    found = scratch.keep(found)
    texts = {r.lang: r.n for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*(F.lit(x) for lang, n in texts.items() for x in (lang, max(2, -(-n // RARE)))))[F.col("lang")]
    shown = found.select("lang", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy("lang", "p.pairs").agg(F.sum("p.counts").alias("n"))
    known: dict[str, set[str]] = {name: set() for name in languages}
    for r in shown.where(F.col("n") >= least).collect():
        known[r.lang].add(r.pairs)
    trained = found.where("dictionary is not null").select("lang", "dictionary")
    most = max(parts.values())
    while most > fan_in:
        most = -(-most // fan_in)
        trained = scratch.keep(trained.groupBy("lang", F.pmod(F.xxhash64("dictionary"), F.lit(most))).applyInArrow(_merge, "lang string, dictionary binary"))
    held: dict[str, list[bytes]] = {}
    for r in trained.collect():  # ``fan_in`` a language at most
        held.setdefault(r.lang, []).append(bytes(r.dictionary))
    delete(spark, scratch.root)
    return [_joined(held[name]) for name in languages if name in held] or [b""], [known[name] for name in languages]


def restored(documents: DataFrame, *, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, restored, chains) of every affected document; restored is null where no decoding helps.

    Null, blank and plain ASCII texts are not affected. A replacement character tells of a wrong decoding whose
    bytes are lost. An empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(documents, key=key, text=text, language=language))
    kind = dict(documents.dtypes)[key]
    schema = documents.select(F.col(key).alias("key"), F.lit("").cast("string").alias("restored"), F.array(F.lit("")).alias("chains")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(*model.value)
        for batch in batches:
            keys, texts, chains = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                garbled, fixed, used = detector.decide(t)
                if garbled:
                    keys.append(k)
                    texts.append(fixed)
                    chains.append(used)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(texts, pa.string()), pa.array(chains, pa.list_(pa.string()))], ["key", "restored", "chains"])

    # Rows that are ASCII throughout never reach Python.
    rows = documents.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(key, text)
    return rows.mapInArrow(run, f"key {kind}, restored string, chains array<string>")
