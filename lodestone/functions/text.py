"""String expressions that the operators share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINATOR = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
WORD = r"[\p{L}\p{N}]+"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: a terminator at the end starts no line; empty and null texts have none."""
    body = F.regexp_replace(text, f"(?:{TERMINATOR})\\z", "")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(body, TERMINATOR))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Last suffix with its dot, lower-cased; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(name, r"[^.].*(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    """Name up to its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def uuid5(name: Column) -> Column:
    """Name-based UUID (SHA-1) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def mentions(question: Column) -> Column:
    """Distinct dotted path-like tokens and words of four characters or more of the lower-cased question."""
    return F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)[\w./-]+\.\w+|\b\w{4,}\b"), 0))
