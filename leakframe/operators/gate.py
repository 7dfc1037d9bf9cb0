"""Line gates: cheap tests that every line with a finding passes.

A gate only saves work, it never changes a result. Trying 27 patterns and three
candidate patterns on every line costs far more than one linear look for the
shape they have in common, so lines are dropped on that shape first. Each gate
is a strict superset of what it stands for:

``run``         a rule value of 20 or more characters of one class, and any
                string long enough to reach the entropy threshold
``assignment``  ``=`` or ``:`` after the end of a key name or after white space,
                followed by at least eight value characters
``url``         ``://`` and ``@``
``pem``         the five-dash header

Custom rules have no shape; their keywords are the gate.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterable
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakframe.functions.text import expand_whitespace
from leakframe.options import ScanOptions
from leakframe.rules import BUILTIN_RULES

# Characters of candidate strings, and the same with the dot of dotted tokens.
# Written out, not as ranges: Java tests such a class with one table look-up.
CANDIDATE_CLASS = string.ascii_letters + string.digits + r"+/=_\-"
_RUN_CLASS = CANDIDATE_CLASS + "."
_HEX_CLASS = string.digits + "abcdefABCDEF"
_RULE_RUN = 20


def fewest_different(options: ScanOptions) -> tuple[int, int]:
    """Least number of different characters of a non-hex and of a hex string that can reach its threshold.

    With k different characters a string has at most log2(k) bits per character.
    """
    return tuple(math.ceil(2**threshold - 1e-6) for threshold in (options.entropy_threshold, options.hex_entropy_threshold))


def shortest_entropy_hit(options: ScanOptions) -> tuple[int, int]:
    """Least length of a non-hex and of a hex string that can reach its threshold."""
    plain, hexa = (max(options.min_length, 12, least) for least in fewest_different(options))
    return plain, hexa


def _run(chars: str, any_length: int, hex_length: int | None = None) -> str:
    """A run of ``any_length`` of the characters, or one that holds ``hex_length`` hex digits.

    The look-behind starts each attempt at the head of a run, which keeps the
    search linear in the line.
    """
    head = f"(?<![{chars}])"
    if hex_length is None or hex_length >= any_length:
        return f"{head}[{chars}]{{{any_length}}}"
    return (
        f"{head}(?=[{chars}]{{{hex_length}}})"
        f"(?:[{chars}]{{{any_length}}}|[{chars}]*?[{_HEX_CLASS}]{{{hex_length}}})"
    )


def entropy_gate(line: Column, options: ScanOptions) -> Column:
    return F.rlike(line, F.lit(_run(CANDIDATE_CLASS, *shortest_entropy_hit(options))))


def shortest_keywords(keywords: Iterable[str]) -> list[str]:
    """The keywords that contain no other one, which is all that "contains any" depends on."""
    distinct = [*dict.fromkeys(keywords)]
    return [k for k in distinct if not any(o != k and o in k for o in distinct)]


def _contains_any(text: Column, keywords: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(k)) for k in shortest_keywords(keywords)])


# Letters that are others' equals where case does not count.
_ALSO = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}
_KEY_NAMES = re.compile(r"\(\?:([A-Za-z_|-]+)\)")


def first_letters(pattern: str) -> str:
    """What the key names that a pattern begins with can begin with, where case does not count."""
    heads = {name[0].lower() for name in _KEY_NAMES.match(pattern)[1].split("|")}
    return "".join(sorted(c for h in heads for c in h + h.upper() + _ALSO.get(h, "")))


def _assignment(patterns: list[str]) -> str:
    """A separator after the end of a key name of ``patterns``, or after white space, and a value.

    Each pattern begins with its key names. The search starts at the separator
    and looks back over a fixed number of characters, so that only separators
    cost more than a step.
    """
    names = [name.lower() for p in patterns for name in _KEY_NAMES.match(p)[1].split("|")]
    endings = sorted({name[-4:] for name in names}, key=lambda e: (len(e), e))
    last = sorted({c for e in endings for c in e[-1] + e[-1].upper() + _ALSO.get(e[-1], "")})
    behind = ["(?<=[\\s][=:])"]
    for length, group in groupby(endings, key=len):
        behind.append(f"(?<=(?iu:{'|'.join(group)})[=:])")
        assert length > 1
    return f"[=:](?<=[\\s{''.join(last)}][=:])(?:{'|'.join(behind)})" + r"""[\s]*["']?[^\s"']{8}"""


_ASSIGNMENT = _assignment([r.pattern for r in BUILTIN_RULES if r.shape == "assignment"])
# Shapes whose test is worth repeating before the keywords of their rules.
GUARDED_SHAPES = ("assignment", "url", "pem")


def shape_test(line: Column, shape: str) -> Column:
    if shape == "run":
        return F.rlike(line, F.lit(_run(_RUN_CLASS, _RULE_RUN)))
    if shape == "assignment":
        return F.rlike(line, F.lit(expand_whitespace(_ASSIGNMENT)))
    if shape == "url":
        return F.contains(line, F.lit("://")) & F.contains(line, F.lit("@"))
    if shape == "pem":
        return F.contains(line, F.lit("-----BEGIN"))
    raise ValueError(f"unknown rule shape {shape!r}")


def line_gate(line: Column, options: ScanOptions) -> Column | None:
    """The test for the options in force; ``None`` if no line may be dropped."""
    custom = [r for r in options.rules if r.shape is None]
    if any(not r.keywords for r in custom):
        return None
    shapes = {r.shape for r in options.rules}
    plain, hexa = shortest_entropy_hit(options)
    tests = []
    if options.entropy_enabled:
        # One search serves entropy and the run rules.
        chars, length = (_RUN_CLASS, min(_RULE_RUN, plain)) if "run" in shapes else (CANDIDATE_CLASS, plain)
        tests.append(F.rlike(line, F.lit(_run(chars, length, hexa))))
    elif "run" in shapes:
        tests.append(shape_test(line, "run"))
    tests += [shape_test(line, s) for s in ("assignment", "url", "pem") if s in shapes]
    if custom:
        tests.append(_contains_any(F.lower(line), [k for r in custom for k in r.keywords]))
    return reduce(or_, tests) if tests else F.lit(False)
