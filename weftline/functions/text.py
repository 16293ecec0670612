"""Text normalisation, signatures and identifiers as column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_source(c: Column) -> Column:
    """Line ends to LF, trailing blanks of each line and trailing empty lines off, one LF at the end."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    t = F.regexp_replace(t, "(?m)[ \t]+$", "")
    return F.concat(F.regexp_replace(t, "\n+$", ""), F.lit("\n"))


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    """First 16 hex digits of the content hash."""
    return F.substring(content_hash(c), 1, 16)


def normalize_diagnostic(c: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def normalize_signature(c: Column, most: int = 500) -> Column:
    """Diagnostic with hexadecimal and decimal numbers replaced by ``<n>``, cut to ``most`` characters."""
    t = F.regexp_replace(F.lower(c), r"0x[0-9a-f]+|[0-9]+", "<n>")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most)


def strip_offset(c: Column) -> Column:
    """Without a trailing `` at N``."""
    return F.regexp_replace(c, r" at [0-9]+$", "")


def strip_comments(c: Column) -> Column:
    """Block comments (an open one cuts the rest), then line comments."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?(\*/|$)", ""), r"(?m)//.*$", "")


def split_multi(c: Column) -> Column:
    """Pieces between ``;``, ``,`` or ``|``, trimmed, empty ones dropped; an empty list for null."""
    parts = F.filter(F.transform(F.split(c, r"[;,|]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def set_text(c: Column, sep: str = ";") -> Column:
    """Canonical text of a set: distinct, sorted, joined."""
    return F.array_join(F.array_sort(F.array_distinct(c)), sep)


def sanitize_name(c: Column) -> Column:
    """Lower case, anything but letters, digits, ``_`` and ``-`` as ``_``; empty becomes ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_-]", "_"), F.lit("")), F.lit("unknown"))


def failure_signature(*parts: Column) -> Column:
    """Fields trimmed, in upper case, joined by ``|``; null counts as empty."""
    return F.array_join(F.array(*[F.upper(F.trim(F.coalesce(p, F.lit("")))) for p in parts]), "|")


#: Other spellings of language names.
LANGUAGE_ALIASES = {"c++": "cpp", "c#": "csharp", "cs": "csharp", "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "golang": "go", "rs": "rust", "kt": "kotlin"}


def normalize_language(c: Column) -> Column:
    """Lower case, trimmed, common aliases resolved."""
    t = F.lower(F.trim(c))
    out = t
    for k, v in LANGUAGE_ALIASES.items():
        out = F.when(t == k, F.lit(v)).otherwise(out)
    return out


def first_present(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def truthy_text(c: Column) -> Column:
    """``1``, ``true`` or ``pass`` in any case; null is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "pass"), F.lit(False))


def hex_value(c: Column) -> Column:
    """Hexadecimal text, with or without ``0x``, as a decimal string of an unsigned 64-bit number."""
    return F.conv(F.regexp_replace(F.lower(F.trim(c)), "^0x", ""), 16, 10)


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, r"[/\\]+$", ""), r"[/\\]"), -1)


def dirname(c: Column) -> Column:
    """Folder part of a path; ``.`` where there is none."""
    t = F.regexp_replace(c, r"[/\\]+$", "")
    return F.when(t.rlike(r"[/\\]"), F.regexp_replace(t, r"[/\\][^/\\]*$", "")).otherwise(F.lit("."))


def labels_of(c: Column, labels: dict[str, str]) -> Column:
    """All labels whose word a text holds, in any case, in the order of ``labels``; none for null."""
    low = F.lower(c)
    return F.filter(F.array(*[F.when(low.contains(w), F.lit(k)) for w, k in labels.items()]), lambda x: x.isNotNull())


def dispatch(c: Column, rules: list[tuple[str, tuple[str, ...]]], names: tuple[str, ...]) -> Column:
    """A struct of the names: the values of the first rule whose word the text holds, else ``UNKNOWN`` in each."""
    shaped = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    out = shaped(("UNKNOWN",) * len(names))
    for word, values in reversed(rules):
        out = F.when(F.lower(c).contains(word), shaped(values)).otherwise(out)
    return out


def validity(status: Column, yes: str, no: str) -> tuple[Column, Column]:
    """Known and value of a status: unknown is neither."""
    known = F.coalesce(status.isin(yes, no), F.lit(False))
    return known, known & (status == yes)


def sha_tagged(tag: str, c: Column) -> Column:
    """SHA-256 of tag, NUL and text."""
    return F.sha2(F.concat(F.lit(tag + "\x00"), c), 256)


def tagged_digest(tag: str, record: Column) -> Column:
    """The digest of a record's canonical JSON (members by name) under a tag."""
    return sha_tagged(tag, canonical_json(record))


def canonical_json(record: Column) -> Column:
    """JSON text whose members stand by name, at every depth: read as a variant, which keeps them sorted."""
    return F.to_json(F.parse_json(F.to_json(record)))
