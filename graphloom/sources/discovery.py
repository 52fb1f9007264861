"""What a listing of files holds: repositories, solutions, projects and settings, and who owns them.

Works on a table `files` (path, is_dir, content), so a listing may come from anywhere; `listing` makes one from a folder
that Spark can read.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.ids import AMBIGUOUS, blank
from ..functions.jsonflat import flatten_rows
from ..operators.numbering import numbered

# File or folder names that mark their folder as a repository.
MARKERS = (".git",)


#: Patterns of exclusion that lie in the root of a workspace, and count without being named.
IGNORE_FILE = ".graphignore"


def listing(spark: SparkSession, root: str, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """files (path, is_dir, content, error) of a local folder: ignored folders are not entered, markers are listed, only
    settings files keep their content. A folder or settings file that cannot be read has a row with its error.

    Hadoop readers skip hidden names, which the markers are, so the folder is walked here; listings of other stores can be
    given to `discover` as a table.
    """
    rows: list[tuple[str, bool, str | None, str | None]] = []
    for folder, dirs, names in os.walk(root, onerror=lambda x: rows.append((x.filename, True, None, x.strerror))):
        rows += [(os.path.join(folder, m), m in dirs, None, None) for m in markers if m in dirs or m in names]
        dirs[:] = sorted(d for d in dirs if d.lower() not in P.IGNORED_DIRECTORIES)
        for name in sorted(names):
            at, text, error = os.path.join(folder, name), None, None
            if re.fullmatch(r"appsettings.*\.json", name.lower()):
                try:
                    with open(at, encoding="utf-8-sig", errors="replace") as f:
                        text = f.read()
                except OSError as x:
                    error = x.strerror
            rows.append((at, False, text, error))
    return spark.createDataFrame(rows, "path string, is_dir boolean, content string, error string")


def excluded_paths(spark: SparkSession, root: str, files: list[str] | None = None, own: list[str] | None = None) -> list[str]:
    """Exclusions of a scan: the patterns of the root's own ignore file where there is one, of `files`, and `own`, each once
    without regard to case, sorted so. A named file that is not there raises FileNotFoundError."""
    default = os.path.join(root, IGNORE_FILE)
    named = [default] if os.path.isfile(default) else []
    for f in files or []:
        if f and f.strip():
            if not os.path.isfile(f):
                raise FileNotFoundError(f"no exclude file {f!r}")
            named.append(f)
    found = []
    for f in named:
        with open(f, encoding="utf-8-sig") as lines:
            rows = list(enumerate(lines.read().splitlines())) or [(0, "")]
        found.append([r.pattern for r in patterns(spark.createDataFrame(rows, "seq long, value string")).collect()])  # lines of one file
    return combined(own, *found)


def patterns(lines: DataFrame) -> DataFrame:
    """(pattern): exclusion patterns from lines of text: trimmed, without blanks and `#` lines, each once without regard to
    case (the first spelling by `seq`), in the order of their upper case."""
    p = F.regexp_replace("value", r"^\s+|\s+$", "")
    kept = lines.select("seq", p.alias("pattern")).where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))
    return kept.groupBy(F.upper("pattern").alias("k")).agg(F.min_by("pattern", "seq").alias("pattern")).orderBy("k").select("pattern")


def ancestors(path: Column) -> Column:
    """All folders above a path, and itself."""
    parts = F.split(P.normal(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def owners(items: DataFrame, repositories: DataFrame, path: str = "path") -> DataFrame:
    """Adds repository_name and repository_path: the deepest repository at or above the path, without regard to case.

    Each path meets only its own ancestors, never every repository.
    """
    up = items.select(F.col(path).alias("o_path")).distinct().withColumn("k", F.explode(ancestors(F.lower("o_path"))))
    roots = repositories.select(F.lower(P.normal(F.col("root_path"))).alias("k"), F.col("name").alias("repository_name"), F.col("root_path").alias("repository_path"))
    best = up.join(roots, "k").groupBy("o_path").agg(F.max_by(F.struct("repository_name", "repository_path"), F.struct(F.length("k"), "repository_name")).alias("o")).select("o_path", "o.*")
    return items.join(best, F.col(path) == F.col("o_path"), "left").drop("o_path")


def once(rows: DataFrame, path: str) -> DataFrame:
    """The first row of each path, without regard to case."""
    n = F.row_number().over(W.partitionBy(F.upper(path)).orderBy("seq", path))
    return rows.withColumn("n", n).where("n = 1").drop("n")


def visible(files: DataFrame, root: str, excluded: list[str], markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Files under the root, outside of ignored folders and exclusions. An exclusion of a folder hides all below it."""
    rel = P.relative(F.col("path"), F.lit(root))
    own = F.coalesce(F.regexp_replace(rel, "[^/]*$", ""), F.lit(""))  # folders on the way; the markers themselves may be ignored names
    shut = F.exists(ancestors(F.col("path")), lambda a: P.excluded(a, F.lit(root), F.array(*map(F.lit, excluded)).cast("array<string>")))
    marked = P.file_name(F.col("path")).isin(*markers)
    inside = F.regexp_replace(own, r"(^|/)(?:" + "|".join(map(re.escape, markers)) + r")/.*$", "$1")
    return files.where(rel.isNotNull() & ~shut & (~P.in_ignored_directory(inside) | marked))


def discover(files: DataFrame, root: str, excluded: list[str] | None = None, markers: tuple[str, ...] = MARKERS) -> dict[str, DataFrame]:
    """The tables workspace, repositories, solutions, projects, config_values and warnings of a listing.

    A root with nothing under it gives empty tables and the warning `root-not-found`. A settings file that is no JSON gives
    `config-parse-failed`; a row of `files` with an `error` (a column that may lack) `directory-scan-failed`. `seq` is the
    place of a row by its path in upper case, and of a setting by its file's and its own place in it; paths count once
    without regard to case.
    """
    excluded = [x for x in excluded or [] if x and x.strip()]
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    seen = visible(files.withColumn("path", P.normal(F.col("path"))), root, excluded, markers)
    seen = numbered(seen.withColumn("upper_path", F.upper("path")), ["upper_path", "path"], "seq").drop("upper_path")
    name, low = P.file_name(F.col("path")), F.lower(P.file_name(F.col("path")))
    inner = F.regexp_extract("path", r"^(.*?)/(?:" + "|".join(m.replace(".", r"\.") for m in markers) + r")(?:/|$)", 1)
    repositories = once(seen.where(inner != "").select(inner.alias("root_path"), "seq"), "root_path").select(P.file_name(F.col("root_path")).alias("name"), "root_path", "seq")

    def kind(suffix: str) -> DataFrame:
        d = once(seen.where(F.endswith(low, F.lit(suffix)) & ~F.coalesce("is_dir", F.lit(False))), "path").select(P.stem(F.col("path")).alias("name"), F.col("path").alias("full_path"), "seq")
        return owners(d, repositories, "full_path")

    settings = once(seen.where(low.rlike(r"^appsettings.*\.json$") & ~F.coalesce("is_dir", F.lit(False))), "path")
    flat = flatten_rows(settings, ["path", "seq"])
    values = numbered(flat.where("not failed").select("key", "value", F.col("path").alias("file_path"), F.col("seq").alias("file_no"), "place"), ["file_no", "place"], "seq")
    config = owners(values.drop("file_no", "place"), repositories, "file_path")
    bad = flat.where("failed").select(F.lit("config-parse-failed").alias("code"), F.concat(F.lit("Failed to parse "), P.file_name(F.col("path"))).alias("message"), "path", F.lit(AMBIGUOUS).alias("certainty"))
    nothing = files.agg(F.count_if(P.is_under(F.col("path"), F.lit(root))).alias("n")).where("n = 0").select(F.lit("root-not-found").alias("code"), F.lit(f"Root does not exist: {root}").alias("message"), F.lit(root).alias("path"), F.lit(0).alias("certainty"))
    unread = seen.where("error is not null").select(F.lit("directory-scan-failed").alias("code"), F.concat(F.lit("Failed to scan "), "path", F.lit(": "), "error").alias("message"), "path", F.lit(AMBIGUOUS).alias("certainty"))
    workspace = files.sparkSession.createDataFrame([(root, 0)], "root_path string, seq long")
    return {"workspace": workspace, "repositories": repositories, "solutions": kind(".sln"), "projects": kind(".csproj"), "config_values": config, "warnings": bad.unionByName(unread).unionByName(nothing)}


def project_list(by_solution: DataFrame, loose: DataFrame) -> DataFrame:
    """Projects of solutions, the last solution of each path holding, and the loose projects that none of them names."""
    k = F.upper(P.normal(F.col("full_path")))
    named = by_solution.withColumn("k", k).groupBy("k").agg(*(F.max_by(x, "seq").alias(x) for x in by_solution.columns))
    rest = loose.withColumn("k", k).join(named.select("k"), "k", "left_anti")
    return named.unionByName(rest, allowMissingColumns=True).drop("k")


def combined(*lists: list[str] | None) -> list[str]:
    """Exclusions from options and files: each once without regard to case, sorted so."""
    first: dict[str, str] = {}
    for own in lists:
        for x in own or []:
            if x and x.strip():
                first.setdefault(x.strip().upper(), x.strip())
    return [first[k] for k in sorted(first)]


def warn_blank(df: DataFrame, col: str) -> DataFrame:
    """Rows whose column is null or blank, which a loader reports instead of loading."""
    return df.where(blank(F.col(col)))
