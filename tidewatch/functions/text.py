"""Text helpers: Column in, Column out, all JVM-side."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters and their Latin counterparts.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "Ѡ": "o",
    "б": "b", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "ı": "i", "İ": "I", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "Α": "A", "Ε": "E", "Ο": "O",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pin(c: Column) -> Column:
    """The same value, computed once: a filter or projection above cannot pull a copy of the expression.

    Predicate pushdown replaces a column by its definition. For a score built from hundreds of tests that repeats all
    of them inside the filter, so wide rule columns are marked as not repeatable.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def nz(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def low(c: Column | str) -> Column:
    return F.lower(nz(c))


def first_filled(*cs: Column | str) -> Column:
    """First value that is neither null nor empty; null when all are."""
    return F.coalesce(*[F.when(col(c).cast("string") != "", col(c)) for c in cs])


def filled(c: Column | str) -> Column:
    return nz(c) != ""


def has(c: Column | str, word: str) -> Column:
    return F.contains(col(c), F.lit(word))


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def has_any(c: Column | str, words: Iterable[str]) -> Column:
    """Any word occurs; words that contain another listed word are implied by it and not tested."""
    words = list(words)
    return any_of(has(c, w) for w in words if not any(o != w and o in w for o in words))


def starts_any(c: Column | str, prefixes: Iterable[str]) -> Column:
    return any_of(F.startswith(col(c), F.lit(p)) for p in prefixes)


def ends_any(c: Column | str, suffixes: Iterable[str]) -> Column:
    return any_of(F.endswith(col(c), F.lit(s)) for s in suffixes)


def count_hits(c: Column | str, words: Iterable[str]) -> Column:
    """How many of the words occur; each word counts once."""
    return functools.reduce(lambda a, b: a + b, [has(c, w).cast("int") for w in words])


def flag(condition: Column) -> Column:
    """Three-valued condition to 0.0/1.0 with null as 0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def search(c: Column | str, pattern: str) -> Column:
    return F.rlike(col(c), F.lit(pattern))


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def listed(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the values whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(k, F.lit(v) if isinstance(v, str) else v) for k, v in pairs]))


def joined(arr: Column, sep: str = ", ") -> Column:
    return F.array_join(arr, sep)


def percent(c: Column, digits: int = 0) -> Column:
    """0.873 -> '87%'."""
    return F.format_string(f"%.{digits}f%%", F.round(c * 100, 9))  # a half is a half, however the sum before it rounded


def basename(c: Column | str) -> Column:
    """Last path part; both separators split."""
    return F.element_at(F.split(nz(c), r"[\\/]"), -1)


@functools.lru_cache(maxsize=None)
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility decompositions cut to ASCII, built from the Unicode tables: one-to-one and one-to-many."""
    single, multi = {}, {}
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(ch):
            continue
        plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1:
            single[ch] = plain
        elif len(plain) > 1:
            multi[ch] = plain
    return single, multi


def fold_ascii(c: Column | str) -> Column:
    """Look-alikes to Latin, compatibility decomposition, non-ASCII and quote characters dropped.

    Plain ASCII text skips every step but the quote removal; the per-character branch runs only for text holding a
    character that decomposes into several ASCII ones.
    """
    source, target, wide_class, wide_from, wide_to = _fold_tables()
    text = nz(c)
    table = F.map_from_arrays(F.split(F.lit(wide_from), "\x01"), F.split(F.lit(wide_to), "\x01"))
    widened = F.array_join(
        F.transform(F.split(text, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")
    text = F.when(search(text, wide_class), widened).otherwise(text)
    folded = F.regexp_replace(F.translate(text, source, target), r"[^\x00-\x7F]", "")
    whole = F.when(F.octet_length(nz(c)) != F.length(nz(c)), folded).otherwise(nz(c))
    return F.translate(whole, "\"'`", "")


@functools.lru_cache(maxsize=None)
def _fold_tables() -> tuple[str, str, str, str, str]:
    """Strings behind fold_ascii: the one-to-one alphabets, and the class and pairs of the one-to-many characters."""
    single, multi = _decompositions()
    one = {**single, **HOMOGLYPHS}
    many = [ch for ch in multi if ch not in HOMOGLYPHS]
    return ("".join(one), "".join(one.values()), "[" + _ranges(many) + "]", "\x01".join(many),
            "\x01".join(multi[ch] for ch in many))


def _ranges(chars: list[str]) -> str:
    """Regex class body covering exactly the given characters."""
    out, codes = [], sorted(ord(ch) for ch in chars)
    start = prev = codes[0]
    for code in codes[1:] + [None]:
        if code is not None and code == prev + 1:
            prev = code
            continue
        out.append(rf"\x{{{start:x}}}-\x{{{prev:x}}}")
        start = prev = code
    return "".join(out)


def shannon_entropy(c: Column | str) -> Column:
    """Bits per character; 0 for empty text."""
    text = nz(c)
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    n = F.size(chars).cast("double")
    terms = F.transform(
        F.array_distinct(chars),
        lambda ch: F.size(F.filter(chars, lambda other: other == ch)).cast("double") / n)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.length(text) == 0, 0.0).otherwise(total)


def unique_ratio(c: Column | str) -> Column:
    """Distinct characters over length; null for empty text."""
    text = nz(c)
    return F.when(F.length(text) > 0,
                  F.size(F.array_distinct(F.filter(F.split(text, ""), lambda ch: ch != ""))) / F.length(text))


def parse_int(c: Column | str) -> Column:
    """Decimal or 0x-hex text to bigint, 0 when neither."""
    text = nz(c)
    hexed = F.conv(F.substring(text, 3, 64), 16, 10).try_cast("bigint")
    return F.coalesce(F.when(F.startswith(text, F.lit("0x")), hexed).otherwise(text.try_cast("bigint")), F.lit(0))


def safe_int(c: Column | str) -> Column:
    return F.coalesce(nz(c).try_cast("int"), F.lit(0))


def is_encoded_command(c: Column | str) -> Column:
    text = nz(c)
    return (F.length(text) >= 20) & search(
        text, r"(?:[-]enc(?:oded)?(?:command)?|[- ][Ee])[\s]+([A-Za-z0-9+/=]{20,})")


def hash_id(*cs: Column, length: int = 16) -> Column:
    """First hex digits of the md5 of key-sorted JSON."""
    return F.substring(F.md5(F.to_json(F.struct(*cs))), 1, length)


def indicator_uid(kind: Column, value: Column) -> Column:
    return F.substring(F.md5(F.concat(kind, F.lit(":"), value)), 1, 12)


def strip_trailing_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+$", "")
