"""Paths: suffixes, prefixes that builds in containers add, headers' libraries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where container builds mount sources and build trees; flags with a path; the C library's own folders.
MOUNTED = "/workspace/"
PATH_FLAGS = ("-I", "-isystem", "-isysroot", "-include", "-iprefix", "-iwithprefixbefore", "-iwithprefix", "-iquote")
LIBC_FOLDERS = ("bits/", "gnu/", "asm/", "asm-generic/", "linux/")
# End of fixed values.


def in_container(path: Column) -> Column:
    return path.startswith(MOUNTED)


def without_container(path: Column) -> Column:
    return F.regexp_replace(path, "^/workspace/(src|build)/", "")


def remap(path: Column, project: str, build: str | None = None) -> Column:
    """Container paths as paths of the project or its build tree; without a build tree that is the project."""
    root, tree = project.rstrip("/"), (build or project).rstrip("/")
    rest = F.substr(path, F.lit(len(MOUNTED) + 1))
    under = lambda folder, to: F.when((rest == folder) | rest.startswith(f"{folder}/"), F.concat(F.lit(to), F.substr(rest, F.lit(len(folder) + 1))))
    inside = F.coalesce(under("src", root), under("build", tree), F.concat(F.lit(f"{tree}/"), rest))
    return F.when(in_container(path), inside).otherwise(path)


def remap_argument(arg: Column, project: str, build: str | None = None) -> Column:
    """The same for a compiler argument that is a path, or a flag with a path."""
    pattern = rf"^({'|'.join(PATH_FLAGS)}|)({MOUNTED}.*)$"
    flag, path = F.regexp_extract(arg, pattern, 1), F.regexp_extract(arg, pattern, 2)
    return F.when(path != "", F.concat(flag, remap(path, project, build))).otherwise(arg)


def suffix(path: Column, parts: int = 3) -> Column:
    """The last parts of a path; a shorter path whole."""
    plain = without_container(path)
    split = F.split(plain, "/")
    return F.when(F.size(split) <= parts, plain).otherwise(F.array_join(F.slice(split, -parts, parts), "/"))


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base(path), r"(?<=.)\.[^.]*$", "")


def header_library(path: Column, known: Column) -> Column:
    """Library of a system header, null for others: the C library's own folders, else by path below include, else by name.

    known: map<string,string> from header to library. A folder of an architecture is left out.
    """
    below = F.regexp_replace(F.regexp_extract(path, "^/usr/(local/)?include/(.*)$", 2), "^[^/]*-linux-[^/]*/", "")
    own = F.lit(False)
    for folder in LIBC_FOLDERS:
        own = own | below.startswith(folder)
    return F.when(below != "", F.when(own, F.lit("libc")).otherwise(F.coalesce(F.try_element_at(known, below), F.try_element_at(known, base(below)))))
