"""Column functions on strings: white space, masking, Shannon entropy, string class."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (Unicode, not ASCII),
# as the inside of a Java character class.
WHITESPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def expand_whitespace(pattern: str, whitespace: str = WHITESPACE) -> str:
    """Spell out ``\\s`` and ``\\S`` in a Java pattern as the Unicode set.

    Java's own ``\\s`` is ASCII only, and its Unicode mode still misses
    U+001C to U+001F.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(whitespace if depth else f"[{whitespace}]")
            i += 2
        elif two == r"\S" and not depth:
            out.append(f"[^{whitespace}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            depth += {"[": 1, "]": -1}.get(pattern[i], 0)
            depth = max(depth, 0)
            out.append(pattern[i])
            i += 1
    return "".join(out)


_CLASS = re.compile(r"\[(?:\\.|[^\]\\])*\]")
_RANGE = re.compile(r"\\.|([A-Za-z0-9])-([A-Za-z0-9])")


def spell_out_ranges(pattern: str) -> str:
    """Write ranges of ASCII letters and digits as their characters: Java tests such a class with one table look-up.

    For patterns whose classes are not nested and name no character by its code,
    other than the set of :func:`expand_whitespace`, and that count case.
    """
    spelt = lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))) if m[1] else m[0]
    return _CLASS.sub(lambda c: _RANGE.sub(spelt, c[0]), pattern)


def is_blank(line: Column) -> Column:
    """True for a line of white space only."""
    return ~F.rlike(line, F.lit(f"[^{WHITESPACE}]"))


def mask(value: Column, max_stars: int | None = None) -> Column:
    """First four characters, the rest as ``*`` (at most ``max_stars`` of them)."""
    hidden = F.length(value) - 4
    stars = F.least(hidden, F.lit(max_stars)) if max_stars is not None else hidden
    return F.when(F.length(value) <= 4, F.repeat(F.lit("*"), F.length(value))).otherwise(
        F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), stars))
    )


def mask_rule_value(value: Column) -> Column:
    return mask(value, max_stars=20)


def mask_entropy_value(value: Column) -> Column:
    return mask(value)


# From this length on characters are counted in sorted order. For shorter values it costs less to look for each one.
COUNTED_SORTED = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counts(chars: Column) -> Column:
    """Map from each character to how often it stands among ``chars``, by the ends of its run in sorted order."""

    def runs(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(ordered, i) != F.get(ordered, i + 1)))
        length = lambda end, k, e: end - F.when(k == 0, -1).otherwise(F.get(e, k - 1))
        return _let(ends, lambda e: F.map_from_arrays(F.transform(e, lambda i: F.get(ordered, i)), F.transform(e, lambda end, k: length(end, k, e))))

    return _let(F.array_sort(chars), runs)


def distinct_chars(value: Column) -> Column:
    """Array of the different characters of a string, in order of first occurrence."""
    return F.array_distinct(F.split(value, ""))


def shannon_entropy(value: Column, distinct: Column | None = None, ascii_only: bool = False) -> Column:
    """Bits per character, -sum(p * log2(p)); 0.0 for the empty string.

    ``distinct`` are its :func:`distinct_chars`, where they are known; with
    ``ascii_only`` a character is known to be a byte. Stays inside the row: the
    character counts come from the string itself, so no explode and no shuffle. Terms are added in order of first occurrence.
    Long values are gone through a fixed number of times, however many different
    characters they have.
    """
    chars = F.split(value, "")
    known = distinct_chars(value) if distinct is None else distinct
    # Log2 is written as a quotient, since Spark's works out the logarithm of 2 anew each time. Bytes are known, where characters are counted.
    total = lambda shares: F.aggregate(shares, F.lit(0.0), lambda acc, share: acc - share * (F.log(share) / F.lit(math.log(2))))
    taken = lambda size, ch: (size - F.octet_length(F.replace(value, ch, F.lit("")))) / F.octet_length(ch)
    each_byte = lambda n: total(F.transform(known, lambda ch: (n - F.octet_length(F.replace(value, ch, F.lit("")))) / n))
    each = each_byte if ascii_only else lambda n: _let(F.octet_length(value), lambda size: total(F.transform(known, lambda ch: taken(size, ch) / n)))
    once = lambda n: _let(chars, lambda cs: _let(_counts(cs), lambda counts: total(F.transform(F.array_distinct(cs), lambda ch: F.element_at(counts, ch) / n))))
    bits = _let(F.length(value).cast("double"), lambda n: F.when(n < COUNTED_SORTED, each(n)).otherwise(once(n)))
    return F.when(value == "", F.lit(0.0)).otherwise(bits)


def is_hex(value: Column) -> Column:
    return F.rlike(value, F.lit(r"^[0-9a-fA-F]*\z"))


def is_base64(value: Column) -> Column:
    return F.rlike(value, F.lit(r"^[A-Za-z0-9+/=]*\z"))


def string_type(value: Column) -> Column:
    """``hex``, else ``base64``, else ``generic``."""
    return F.when(is_hex(value), "hex").when(is_base64(value), "base64").otherwise("generic")


def decode_utf8(content: Column) -> Column:
    """Bytes to text, invalid sequences replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def fold_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` to ``\\n``, as reading a file in text mode does."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def fingerprint(content: Column, salt: str = "") -> Column:
    """SHA-256 hex of the content; a salt (a rule-set id) makes a new key space."""
    digest = F.sha2(content, 256)
    return F.sha2(F.concat(F.lit(salt + ":"), digest), 256) if salt else digest
