"""Path and name functions, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(segments: Column) -> Column:
    return F.array_join(segments, "/")


def split(path: Column) -> Column:
    """Segments that are not empty."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def parent(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def canonical(path: Column) -> Column:
    """Whether a path has no leading, trailing or double slash."""
    return ~path.rlike("^/|/$|//")


def top_directory(path: Column) -> Column:
    """First segment; files of the root are '(root)'."""
    return F.when(F.instr(path, "/") == 0, "(root)").otherwise(F.substring_index(path, "/", 1))


def directory_at(path: Column, depth: int) -> Column:
    """Directory prefix of ``depth`` segments with a closing slash; a shallower file's own directory, or '(root)'."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, "(root)").otherwise(F.concat(F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/"), F.lit("/")))


def file_type(path: Column) -> Column:
    """Kind of a source file by its name: Makefile, Kconfig, .c, .h, .S, or other."""
    name = basename(path)
    named = lambda n: (name == n) | F.startswith(name, F.lit(f"{n}."))
    end = F.regexp_extract(name, r"(\.(?:c|h|S))$", 1)
    return F.when(named("Makefile"), "Makefile").when(named("Kconfig"), "Kconfig").when(end != "", end).otherwise("other")


def depth(path: Column) -> Column:
    return F.size(split(path))


def organisation(email: Column) -> Column:
    """Lower-cased domain after the first @, else 'unknown'."""
    domain = F.lower(F.trim(F.regexp_extract(email, "@(.*)$", 1)))
    return F.when(domain == "", "unknown").otherwise(domain)


def glob(text: Column, pattern: str) -> Column:
    """Whole-text match where * is any run of characters and ? is any one; all else is literal."""
    special = {"*": ".*", "?": "."}
    escape = "".join(special.get(c, c if c.isalnum() or c in " /_-" else "\\" + c) for c in pattern)
    return text.rlike(f"(?s)^{escape}$")


def slug(text: Column) -> Column:
    """Lower-cased runs of letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
