"""Column functions on paths: extension, base name, normal form, ignore globs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot; leading dots of a name do not count."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1))


def strip_file_scheme(path: Column) -> Column:
    """``file:/a`` and ``file:///a`` to ``/a``; other schemes stay."""
    return F.regexp_replace(path, r"^file:/+", "/")


def normalise(path: Column, root: str = "/") -> Column:
    """Absolute path with ``.``, ``..`` and repeated slashes folded.

    Relative paths are taken below ``root``. A ``scheme://host`` prefix is kept.
    """
    base = root.rstrip("/") + "/"
    clean = strip_file_scheme(path)
    scheme = F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1)
    local = F.substring(clean, F.length(scheme) + 1, F.length(clean))
    absolute = F.when(F.startswith(local, F.lit("/")) | (scheme != ""), local).otherwise(
        F.concat(F.lit(base), local)
    )
    # Exactly two leading slashes have a meaning of their own and stay.
    lead = F.when(F.rlike(absolute, F.lit("^//(?!/)")) & (scheme == ""), "//").otherwise("/")

    def step(parts, part):
        return (
            F.when(part.isin("", "."), parts)
            .when(part == "..", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
            .otherwise(F.concat(parts, F.array(part)))
        )

    parts = F.aggregate(F.split(absolute, "/"), F.array().cast("array<string>"), step)
    # Most paths have nothing to fold, which is much cheaper to see than to fold.
    folded = F.startswith(clean, F.lit("/")) & ~F.rlike(clean, F.lit(r"/(?:\.{0,2}/|\.{0,2}\z)"))
    return F.when(folded, clean).otherwise(F.concat(scheme, lead, F.array_join(parts, "/")))


def below(path: Column, root: str) -> Column:
    """Path relative to ``root``; paths elsewhere stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)


def glob_to_regex(glob: str) -> str:
    """Shell-style glob as an anchored Java pattern; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            out.append(_set_to_class(glob[i + 1 : close]))
            i = close
        else:
            out.append(_quote(ch))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def _quote(ch: str) -> str:
    return ch if ch.isalnum() or ch in "/_ " or ord(ch) > 127 else "\\" + ch


def _set_to_class(body: str) -> str:
    negate = body.startswith("!")
    body = body[1:] if negate else body
    items, i = [], 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            if body[i] <= body[i + 2]:
                items.append(f"{_quote(body[i])}-{_quote(body[i + 2])}")
            i += 3
        else:
            items.append(_quote(body[i]))
            i += 1
    if not items:
        return "." if negate else "(?!)"
    return f"[{'^' if negate else ''}{''.join(items)}]"


def matches_globs(path: Column, globs: list[str] | tuple[str, ...], relative: Column | None = None) -> Column:
    """True if a glob hits the path, the path below the root, or the base name,
    or a glob ending in ``/`` is a prefix of the path.

    All globs become one alternation, so each path is matched once however
    long the list is.
    """
    if not globs:
        return F.lit(False)
    views = [path, basename(path)] + ([relative] if relative is not None else [])
    pattern = F.lit("|".join(f"(?:{glob_to_regex(g)})" for g in globs))
    tests = [F.rlike(view, pattern) for view in views]
    for prefix in (g for g in globs if g.endswith("/")):
        tests += [F.startswith(view, F.lit(prefix)) for view in ([path] + views[2:])]
    return reduce(or_, tests)
