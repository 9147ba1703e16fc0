"""Scalar functions over texts, as Catalyst expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Word lists and patterns that decide results.
WHITESPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKEN = r"[a-z0-9][a-z0-9.%/-]*"
SUFFIXES = ("ing", "ed", "es", "s")
JOINED = r"(?i)\b(and|or|as well as|along with)\b|\b(both|all|each|neither|either|the two|they|these|those)\b|,\s*\w+(\s+\w+){0,3}\s*,|^(E\d+|Panelist\s+\w+|Agent\s+\w+)\s+\w+|\b(claims?|shows?|argues?|states?|asserts?|reports?|notes?|identifies)\s+that\b"
UNRESOLVED = r"(?i)^(he|she|it|this|that|these|those|the (series|film|movie|study|book|author|company|article|documents?|position|office|award|trial|program))\b"
QUANTIFIED = r"(?i)^(both|all|each|neither|either|they|the (two|three|four)|no other)\b"
SOURCE_META = r"(?i)\b(the documents?|the (text|passage|context|entries|entry)|according to the (documents?|text))\b|\b(state[sd]?|describe[sd]?|mention[sd]?|list(ed|s)?) (that|the|it|them)\b"
RESOLVED_INLINE = r"^[Tt]he\s+\w+\s+((of|for|is|was|named|called|titled)\s+)?[\"'\x{201c}]?[A-Z0-9]"
CONJUNCTION = r"(?i),\s+\w+,?\s+and\s+\w|\b(is|was|are|were)\b[^.]*\b\w+\s+and\s+\w+"
NUMBER = r"\d+(?:\.\d+)?%?"


def norm_text(c: Column) -> Column:
    """Lower case, whitespace runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), WHITESPACE, " "))


def norm_text_rstrip(c: Column) -> Column:
    return F.regexp_replace(norm_text(c), r"\.+$", "")


def norm_word(c: Column) -> Column:
    """Letters and digits of any alphabet, all else one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def norm_ascii(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def make_fact_id(c: Column) -> Column:
    return F.concat(F.lit("f_"), F.substring(F.sha1(norm_text(c).cast("binary")), 1, 16))


def make_mention_id(text: Column, execution: Column, agent: Column, round_: Column, channel: Column) -> Column:
    """m_ and the start of a SHA-1 over the text and its slot, written as a tuple with None for nulls."""
    quoted = lambda c: F.when(c.isNull(), "None").otherwise(F.concat(F.lit("'"), c, F.lit("'")))
    slot = F.concat(F.lit("("), quoted(execution), F.lit(", "), quoted(agent), F.lit(", "), F.coalesce(round_.cast("string"), F.lit("None")), F.lit(", "), quoted(channel), F.lit(")"))
    return F.concat(F.lit("m_"), F.substring(F.sha1(F.concat(text, F.lit("|"), slot).cast("binary")), 1, 16))


def stem(token: Column) -> Column:
    out = F.when(token.rlike("[0-9]"), token)
    for s in SUFFIXES:
        out = out.when((F.length(token) > len(s) + 2) & token.endswith(s), F.substring(token, F.lit(1), F.length(token) - len(s)))
    return out.otherwise(token)


def tokenize(c: Column) -> Column:
    """The set of stemmed tokens, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), stem)))


def containment(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(0.0)


def looks_joined(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(JOINED)


def unresolved(c: Column) -> Column:
    return c.rlike(UNRESOLVED) & ~c.rlike(RESOLVED_INLINE) & ~c.rlike(QUANTIFIED)


def slot_label(channel: Column, agent: Column, round_: Column) -> Column:
    return F.when(channel == "source", "SRC").otherwise(F.concat(F.coalesce(agent, F.lit("?")), F.coalesce(round_.cast("string"), F.lit("?"))))


def last_line(c: Column, marker: str, limit: int = 120) -> Column:
    """What follows the marker in the last line that begins with it, else so many characters of the last line, else nothing."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda x: x != "")
    marked = F.try_element_at(F.filter(lines, lambda x: F.upper(x).startswith(marker.upper())), F.lit(-1))
    rest = F.regexp_replace(F.substring(marked, F.lit(len(marker) + 1), F.length(marked)), r"^[ \t]+|[ \t]+$", "")
    return F.when(marked.isNotNull(), rest).otherwise(F.coalesce(F.substring(F.try_element_at(lines, F.lit(-1)), 1, limit), F.lit("")))


#: Fixed patterns: the answer letter, a verdict, openings that leave a referent open, and names of two capitalised words or more.
ANSWER_LETTER = r"(?i)FINAL ANSWER:\s*\(?([A-J])\)?"
VERDICT = r"(?i)VERDICT\s*[:：]\s*([A-Za-z_ ]+)"
FORBIDDEN_OPENERS = r"(?i)^(both|he|she|they|it|this|these|those)\b|^the (series|film|study|book|author|documents?)\s+(is|was|are|were|has|had|consists)"
_NAME = r"\p{Lu}[\p{L}\p{N}_\x{2019}\-]*"
_BETWEEN = r"(?:\s+(?:of|for|the|and|in|de|von|van)\s+|\s+)"
PROPER = rf"(?:^|[^\p{{L}}\p{{N}}_])({_NAME}(?:{_BETWEEN}{_NAME})+)"


def answer_letter(c: Column) -> Column:
    return F.coalesce(F.upper(F.try_element_at(F.regexp_extract_all(c, F.lit(ANSWER_LETTER), F.lit(1)), F.lit(-1))), F.lit(""))


def verdict(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_extract(c, VERDICT, 1)))


def proper_spans(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PROPER), F.lit(1))


def without_shared_names(a: Column, b: Column) -> tuple[Column, Column]:
    """Both texts, lower-cased, without the names that both hold, the longest taken out first."""
    low = lambda c: F.transform(proper_spans(c), lambda s: F.lower(s))
    names = F.array_sort(F.transform(F.array_intersect(low(a), low(b)), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    cut = lambda c: F.aggregate(names, F.lower(c), lambda text, n: F.replace(text, n["s"], F.lit(" ")))
    return cut(a), cut(b)


def shorten(c: Column, limit: int) -> Column:
    """Whitespace folded; under the limit as it is, else cut behind the last sentence or clause that ends past half the
    limit, else after the last whole word, with dots."""
    text = F.trim(F.regexp_replace(c, WHITESPACE, " "))
    head = F.substring(text, 1, limit)
    end = F.greatest(F.length(F.regexp_extract(head, r"^(.*)\. ", 1)) + F.when(head.contains(". "), 1).otherwise(0), F.length(F.regexp_extract(head, r"^(.*); ", 1)) + F.when(head.contains("; "), 1).otherwise(0))
    return F.when(F.length(text) <= limit, text).when(end - 1 >= limit // 2, F.substring(text, F.lit(1), end)).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(" ...")))


def entail_label(ab: Column, ba: Column, threshold: float) -> Column:
    """Four-way label of two one-way margins."""
    f, b = ab >= threshold, ba >= threshold
    return F.when(f & b, "EQUIVALENT").when(f, "A_ENTAILS_B").when(b, "B_ENTAILS_A").otherwise("UNRELATED")


def flipped(label: Column) -> Column:
    return F.when(label == "A_ENTAILS_B", "B_ENTAILS_A").when(label == "B_ENTAILS_A", "A_ENTAILS_B").otherwise(label)


def band(similarity: Column, reject: float, accept: float) -> Column:
    return F.when(similarity < reject, "UNRELATED").when(similarity >= accept, "EQUIVALENT").otherwise("ask")
