"""Text functions of the store, all built-in column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _latin_bases() -> dict[str, str]:
    """Small Latin letters with marks and their base letters, by decomposition; the final sigma folds by case."""
    out = {"ς": "σ"}
    for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c.islower() and base.isascii() and base.isalpha():
            out[c] = base
    return out


MARKED, FOLDED = "".join(_latin_bases()), "".join(_latin_bases().values())
SPACES = r"(?U)^\s+|\s+$"


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, SPACES, "")


def approximate_tokens(text: Column) -> Column:
    """Estimate of model tokens: UTF-8 bytes divided by four, rounded down."""
    return (F.octet_length(text) / 4).cast("long")


def fold_words(text: Column) -> Column:
    """Index terms of a text: runs of letters and digits, lower case, Latin marks removed."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, FOLDED)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(text: Column) -> Column:
    """Search terms: runs of letters, digits, '_', '-' and '.' of two characters or more."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}_.-]+)"), F.lit(1)), lambda t: F.length(t) >= 2)


def record_hash(record_id: Column, body: Column) -> Column:
    """SHA-256 of record id, a zero byte and body."""
    return F.sha2(F.concat(record_id.cast("binary"), F.unhex(F.lit("00")), body.cast("binary")), 256)


def humanize_bytes(size: Column) -> Column:
    """Bytes in steps of 1024 with one decimal: '1.5 KB'."""
    out = F.format_string("%.1f B", size.cast("double"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size.cast("double") / float(1024**power))).otherwise(out)
    return out


def derive_title(content: Column) -> Column:
    """First line that is not blank, cut to 77 characters and '...' beyond 80; '(untitled)' if none."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"\r?\n"), trim_all), lambda s: s != "")
    first = F.get(lines, F.lit(0))
    return F.when(first.isNull(), "(untitled)").when(F.length(first) > 80, F.concat(F.substring(first, 1, 77), F.lit("..."))).otherwise(first)


def canonical_source(source: Column, fallback: Column) -> Column:
    """A note's source: as it is with a scheme, else below mcp://, or named by `fallback` if blank."""
    s = trim_all(F.coalesce(source, F.lit("")))
    return F.when(s == "", F.concat(F.lit("mcp://note/"), fallback)).when(s.contains("://"), s).otherwise(F.concat(F.lit("mcp://"), s))


def strip_html(markup: Column) -> Column:
    """Text of HTML: scripts, styles and tags dropped, entities kept, an unclosed tag drops the rest."""
    out = markup
    for name in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{name}[^>]*>.*?</{name}[^>]*>", "")
    return F.regexp_replace(out, r"(?s)<[^>]*>|>|<[^>]*$", "")


def collapse_whitespace(text: Column) -> Column:
    """Lines trimmed, runs of blank lines made one line end, each kept line ended by one."""
    lines = F.transform(F.split(text, "\n"), trim_all)
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n{2,}", "\n")
    return F.when(F.regexp_replace(joined, r"\n", "") == "", "").otherwise(F.concat(F.regexp_replace(joined, r"^\n+|\n+$", ""), F.lit("\n")))


def ascii_lower(text: Column) -> Column:
    """ASCII letters in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def file_stem(path: Column) -> Column:
    """A file's name without folder and last extension; 'untitled' if nothing is left."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:(?<=[^/])\.[^./]*)?$", 1)
    return F.when(stem != "", stem).otherwise("untitled")


def contains_folded(text: Column, part: str) -> Column:
    """Whether text holds part, ASCII letters compared without case; null text never does."""
    return F.coalesce(ascii_lower(text).contains(ascii_lower(F.lit(part))), F.lit(False))
