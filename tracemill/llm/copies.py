"""Duplicates hidden by formatting differences.

Method: Merkle-style hashing from the leaves up. A text leaf is freed of case, whitespace and punctuation,
a number brought to one form; the digests of an object's fields are sorted, those of a list kept in order;
records with one root digest are a group, and a group counts only after its whole structures compare equal.

Records are grouped by partial aggregation (smallest row, row count, smallest and largest structure), so a
record that makes up a third of all rows is reduced before the shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracemill.runtime import Scratch

#: Everything but letters, digits and the marks on them; symbols outside ASCII (a currency sign, say) stay.
_DROP = re.compile(r"[\W_]+")
_KEEP = re.compile(r"[^\x00-\x7f]")


def plain(text: str) -> str:
    """The text without case, whitespace and punctuation."""
    import unicodedata as ud

    def kept(found: re.Match) -> str:
        run = found.group()
        return "" if run.isascii() else "".join(c for c in run if _KEEP.match(c) and ud.category(c)[0] in "MS")

    return _DROP.sub(kept, text.lower())


class Fields(list):
    """The fields of one JSON object in their order; a name may stand twice."""


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(payload: str | None):
    """The payload's value; ValueError if it isn't valid JSON."""
    if payload is None:
        raise ValueError("null")
    return json.loads(payload, object_pairs_hook=Fields, parse_constant=_refuse)


_TOKEN = re.compile(r'[\s]*("(?:[^"\\\x00-\x1f]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+)')


def parse_deep(payload: str):
    """``parse`` with a stack of its own, for payloads nested beyond the interpreter's."""
    at, end = 0, len(payload.rstrip(" \t\n\r"))
    stack: list[tuple[list, str | None]] = []
    done, value, name, expect = False, None, None, "value"
    while at < end:
        m = _TOKEN.match(payload, at, end)
        if not m or done:
            raise ValueError("not JSON")
        at, token = m.end(), m.group(1)
        if expect == "name" or expect == "name or end" and token != "}":
            if token[0] != '"':
                raise ValueError("not JSON")
            name, expect = json.loads(token), "colon"
            continue
        if expect == "colon":
            if token != ":":
                raise ValueError("not JSON")
            expect = "value"
            continue
        if token in "[{" and expect.startswith("value"):
            stack.append((Fields() if token == "{" else [], name))
            expect = "name or end" if token == "{" else "value or end"
            continue
        if expect == "comma or end" and token == ",":
            expect = "name" if isinstance(stack[-1][0], Fields) else "value"
            continue
        if token in "]}" and expect.endswith("or end") and isinstance(stack[-1][0], Fields) == (token == "}"):
            value, name = stack.pop()
        elif expect.startswith("value"):
            value = parse(token)
        else:
            raise ValueError("not JSON")
        if not stack:
            done = True
            continue
        stack[-1][0].append((name, value) if isinstance(stack[-1][0], Fields) else value)
        expect = "comma or end"
    if not done:
        raise ValueError("not JSON")
    return value


def _leaf(node) -> tuple[bytes, str]:
    if isinstance(node, str):
        leaf = '"' + plain(node)
    elif node is None or isinstance(node, bool):
        leaf = json.dumps(node)
    else:
        leaf = "#" + (str(int(node)) if node == node and abs(node) < 2**53 and node == int(node) else repr(node))
    return xxhash.xxh3_128_digest(leaf.encode("utf-8", "surrogatepass")), leaf


def _joined(node: list, parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    """(digest, structure) of an object or list from those of its children."""
    left, right = "[]"
    if isinstance(node, Fields):
        left, right = "{}"
        names = [plain(name) for name, _ in node]
        parts = sorted((xxhash.xxh3_128_digest(n.encode("utf-8", "surrogatepass") + b"\0" + d), f"{json.dumps(n)}:{s}") for n, (d, s) in zip(names, parts))
    return xxhash.xxh3_128_digest(left.encode() + b"".join(d for d, _ in parts)), left + ",".join(s for _, s in parts) + right


def merkle(node) -> tuple[bytes, str]:
    """(digest, structure) of a node: equal for records that differ in formatting and field order only."""
    if not isinstance(node, list):
        return _leaf(node)
    below = [value for _, value in node] if isinstance(node, Fields) else node
    return _joined(node, [merkle(x) for x in below])


def merkle_deep(node) -> tuple[bytes, str]:
    """``merkle`` with a stack of its own."""
    stack, out = [(node, False)], []
    while stack:
        x, ready = stack.pop()
        if not isinstance(x, list):
            out.append(_leaf(x))
        elif ready:
            at = len(out) - len(x)
            out[at:] = [_joined(x, out[at:])]
        else:
            stack.append((x, True))
            stack += [(v[1] if isinstance(x, Fields) else v, False) for v in reversed(x)]
    return out[0]


def root(x: str | None, nested: bool) -> tuple[bytes, str]:
    try:
        return merkle(parse(x) if nested else x)
    except RecursionError:
        return merkle_deep(parse_deep(x))


def digests(df: DataFrame, key: str, column: str, nested: bool) -> DataFrame:
    """(row_no, digest, structure) of each record: of a JSON payload if nested, else of a text as one leaf.

    Payloads that aren't valid JSON and null texts give no row; a text without letters or digits is one
    like all others without.
    """
    schema = pa.schema([("row_no", pa.int64()), ("digest", pa.binary()), ("structure", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, roots, whole = [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    digest, structure = root(x, nested)
                except (ValueError, OverflowError):
                    continue
                rows.append(k)
                roots.append(digest)
                whole.append(structure.encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(roots, pa.binary()), pa.array(whole, pa.string())], schema=schema)

    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long"), F.col(column))
    return rows.mapInArrow(run, "row_no long, digest binary, structure string")


def collapse(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(copies, rows) of records(tbl, row_no, digest, structure): copies(tbl, digest, structure, first_row_no,
    last_row_no) one a group, structure null but where one digest has several; rows as kept on the way."""
    rows = scratch.keep(records)
    groups = rows.groupBy("tbl", "digest").agg(F.min("row_no").alias("first_row_no"), F.max("row_no").alias("last_row_no"), F.min("structure").alias("low"), F.max("structure").alias("high"))
    groups = scratch.keep(groups.where("first_row_no < last_row_no").withColumn("split", F.col("low") != F.col("high")).drop("low", "high"))
    whole = groups.where("not split").select("tbl", "digest", F.lit(None).cast("string").alias("structure"), "first_row_no", "last_row_no")
    split = rows.join(groups.where("split").select("tbl", "digest"), ["tbl", "digest"], "left_semi")
    split = split.groupBy("tbl", "digest", "structure").agg(F.min("row_no").alias("first_row_no"), F.max("row_no").alias("last_row_no")).where("first_row_no < last_row_no")
    return whole.unionByName(split), rows


def copied_rows(records: DataFrame) -> DataFrame:
    """(tbl, row_no, first_row_no) of every record with a copy in its own table, the first included.

    Rows of one row_no are one record. Empty tables give an empty result.
    """
    scratch = Scratch(records.sparkSession, "copies")
    groups, rows = collapse(records, scratch)
    out = rows.join(groups.withColumnRenamed("structure", "only"), ["tbl", "digest"]).where("only is null or only = structure")
    return out.select("tbl", "row_no", "first_row_no").distinct()


def counted_copies(records: DataFrame) -> DataFrame:
    """(tbl, first_row_no, copies): each record once, with the number of its copies, itself included.

    Structures are compared by their smallest and largest for a digest, and shuffled whole only where one digest has several.
    """
    rows = Scratch(records.sparkSession, "counts").keep(records)
    split = rows.groupBy("tbl", "digest").agg(F.min("structure").alias("low"), F.max("structure").alias("high")).where("low <> high").select("tbl", "digest", F.lit(True).alias("split"))
    told = rows.join(split, ["tbl", "digest"], "left").select("tbl", "row_no", "digest", F.when(F.col("split"), F.col("structure")).alias("structure")).distinct()
    return told.groupBy("tbl", "digest", "structure").agg(F.min("row_no").alias("first_row_no"), F.count("*").alias("copies")).select("tbl", "first_row_no", "copies")


def domain_records(mentions: DataFrame, facts: DataFrame, fact_dumps: DataFrame) -> DataFrame:
    tables = [("mentions", mentions, "ord", "text", False), ("facts", facts, "ord", "canonical_text", False), ("fact_dumps", fact_dumps, "dump_id", "payload", True)]
    parts = [digests(df, key, column, nested).select(F.lit(name).alias("tbl"), "*") for name, df, key, column, nested in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
