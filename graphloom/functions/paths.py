"""Path predicates. Paths use `/` or `\\`; comparisons do not regard letter case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions whose change calls for a new scan.
RESCAN_EXTENSIONS = (".cs", ".csproj", ".sln", ".props", ".targets", ".json", ".xml")
# Directories that are never entered.
IGNORED_DIRECTORIES = (".git", ".hg", ".svn", "bin", "obj", "node_modules", ".idea", ".vs")


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normal(path: Column) -> Column:
    """Forward slashes, `.` and empty segments dropped, no separator at the end."""
    p = F.regexp_replace(F.regexp_replace(slashed(path), r"/(\./)+", "/"), r"/{2,}", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/\.?$", ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def is_under(path: Column, root: Column) -> Column:
    """Equal to the root or below it."""
    p, r = F.lower(normal(path)), F.lower(normal(root))
    return (p == r) | F.startswith(p, F.concat(F.when(r == "/", F.lit("")).otherwise(r), F.lit("/")))


def relative(path: Column, root: Column) -> Column:
    """Path from the root; null where it does not lie under it, `.` for the root itself."""
    p, r = normal(path), normal(root)
    return F.when(F.lower(p) == F.lower(r), F.lit(".")).when(is_under(path, root), F.substring(p, F.length(r) + F.when(r == "/", 1).otherwise(2), F.length(p)))


def is_rooted(path: Column) -> Column:
    return F.startswith(slashed(path), F.lit("/")) | path.rlike("^[A-Za-z]:")


def excluded(path: Column, root: Column, patterns: Column) -> Column:
    """Does any exclusion pattern (an array column) match? A rooted pattern matches what is under it; another one a
    leading part of the relative path, or whole segments anywhere in the absolute path. Blank patterns match nothing."""
    whole = F.lower(normal(path))
    own = F.lower(F.coalesce(relative(path, root), normal(path)))

    def hit(raw: Column) -> Column:
        p = F.regexp_replace(raw, r"^\s+|\s+$", "")
        q = F.lower(F.btrim(slashed(p), F.lit("/")))
        free = (q != "") & ((own == q) | F.startswith(own, F.concat(q, F.lit("/"))) | F.contains(whole, F.concat(F.lit("/"), q, F.lit("/"))) | F.endswith(whole, F.concat(F.lit("/"), q)))
        return F.coalesce(F.when(is_rooted(p), is_under(path, p)).otherwise(free), F.lit(False))

    return F.coalesce(F.exists(patterns, hit), F.lit(False))


def in_ignored_directory(relative_path: Column) -> Column:
    """Does any directory on the way have an ignored name? The last segment counts, as it may be a directory itself."""
    return F.arrays_overlap(F.split(F.lower(slashed(relative_path)), "/"), F.array(*map(F.lit, IGNORED_DIRECTORIES)))


def is_generated(path: Column) -> Column:
    p = F.lower(slashed(path))
    return F.contains(p, F.lit("/obj/")) | F.endswith(p, F.lit(".g.cs")) | F.endswith(p, F.lit(".designer.cs"))


def calls_for_rescan(path: Column, root: Column, patterns: Column, ignore_file: str = ".graphignore") -> Column:
    """Under the root, and the ignore file itself or a source file that is not excluded."""
    source = ~excluded(path, root, patterns) & extension(path).isin(*RESCAN_EXTENSIONS)
    return F.coalesce(is_under(path, root) & ((F.lower(file_name(path)) == ignore_file) | source), F.lit(False))


def change_reason(kind: Column, path: Column, root: Column) -> Column:
    return F.concat(kind, F.lit(": "), F.coalesce(relative(path, root), normal(path)))


def safe_file_name(name: Column) -> Column:
    """Characters that a file name may not hold become `_`."""
    return F.regexp_replace(name, r"[/\x00]", "_")
