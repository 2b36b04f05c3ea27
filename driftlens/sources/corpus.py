"""Source trees as DataFrames: one row per file with its whole text."""

from __future__ import annotations

import fnmatch
import os
import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.session import stage

# The functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXTENSIONS = ("py", "graphql", "gql")

# Folders left out by default. Folders that only one project has are for the caller to add.
SCAN_EXCLUSIONS = (".git", ".venv", "venv", "node_modules", "__pycache__")
DEFAULT_EXCLUSIONS = (
    "venv", ".venv", "__pycache__", ".git", "node_modules", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".github",
    "doc", "load_tests", "pyright-sample", "volume", "tests", "openapi", "schema", "scripts",
)


def below(path: Column, root: str) -> Column:
    """The part of a file's path below the scanned folder."""
    clean = root.split(":", 1)[-1].rstrip("/") if "://" in root or root.startswith("file:") else root.rstrip("/")
    return F.substring_index(path, clean + "/", -1)


def excluded_names(path: Column, names: Iterable[str]) -> Column:
    """The path has a folder with one of the names, or is a Python file with one of the names."""
    names = list(names)
    if not names:
        return F.lit(False)
    steps = F.split(path, "/")
    folders = F.slice(steps, F.lit(1), F.size(steps) - 1)
    last = F.element_at(steps, -1)
    return F.exists(folders, lambda f: f.isin(names)) | (last.isin(names) & last.endswith(".py"))


def excluded_patterns(path: Column, patterns: Iterable[str]) -> Column:
    """The path has a folder that matches one of the shell patterns."""
    regex = "|".join(fnmatch.translate(p).replace(r"\Z", r"\z") for p in patterns)
    if not regex:
        return F.lit(False)
    steps = F.split(path, "/")
    return F.exists(F.slice(steps, F.lit(1), F.size(steps) - 1), lambda f: f.rlike(f"^(?:{regex})$"))


def _place(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path, and what stands before a path in a file's name: nothing for local files."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.rstrip("/") or "/", ""
    system, path = pafs.FileSystem.from_uri(uri)
    path = path.rstrip("/") or "/"
    return system, path, "" if system.type_name == "local" else uri.rstrip("/").removesuffix(path)


def _listed(folders: DataFrame, root: str) -> DataFrame:
    """``(path, folder, problem)`` of what the folders hold; a folder that cannot be listed has a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _, _ = _place(root)
        for batch in batches:
            found: list[tuple] = []
            for folder in batch.column(0).to_pylist():
                try:
                    for item in system.get_file_info(pafs.FileSelector(folder)):
                        is_folder = item.type == pafs.FileType.Directory
                        # A link to a folder may lead back to one of its parents.
                        if not (is_folder and system.type_name == "local" and os.path.islink(item.path)):
                            found.append((item.path, is_folder, None))
                except OSError as problem:
                    found.append((folder, False, f"the folder cannot be listed: {type(problem).__name__}"))
            columns = list(zip(*found)) or [(), (), ()]
            kinds = (pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "folder", "problem"])

    return folders.select("path").mapInArrow(run, "path string, folder boolean, problem string")


def scan(
    spark: SparkSession,
    root: str,
    names: Iterable[str] = SCAN_EXCLUSIONS,
    patterns: Iterable[str] = (),
) -> DataFrame:
    """``(file, ext, source, problem)`` of the Python and operation files in a folder tree, or of a single file.

    Folders are listed and files are read inside tasks, level by level, so files and folders whose names start with a
    dot or an underscore count like any other (Spark's own readers leave them out). A file or folder that cannot be read
    is a row with a ``problem`` and without a source.
    """
    _, top, prefix = _place(root)
    names, patterns = list(names), list(patterns)
    wanted = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*EXTENSIONS) & F.col("path").contains(".")
    if top.endswith(tuple("." + e for e in EXTENSIONS)):
        files = spark.createDataFrame([(top, None)], "path string, problem string")
    else:
        level, parts = spark.createDataFrame([(top,)], "path string"), []
        while True:
            found = _listed(level.repartition("path"), root)
            inner = below(F.col("path"), top)
            # The name of a folder is tested with a file's name behind it.
            as_folder = F.when(F.col("folder"), F.concat(inner, F.lit("/-"))).otherwise(inner)
            kept = stage(found.filter(~excluded_names(as_folder, names) & ~excluded_patterns(as_folder, patterns)), "level")
            parts.append(kept.filter(~F.col("folder") & (wanted | F.col("problem").isNotNull())).select("path", "problem"))
            level = kept.filter("folder")
            if level.isEmpty():
                break
        files = reduce(DataFrame.unionByName, parts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _, _ = _place(root)
        for batch in batches:
            for path, problem in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = None
                if problem is None:
                    try:
                        with system.open_input_stream(path) as file:
                            source = file.read()
                    except OSError as reason:
                        problem = f"the file cannot be read: {type(reason).__name__}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([source], pa.binary()), pa.array([problem], pa.string())], names=["path", "source", "problem"]
                )

    read_files = files.repartition("path").mapInArrow(read, "path string, source binary, problem string")
    return read_files.select(
        F.concat(F.lit(prefix), "path").alias("file"),
        F.element_at(F.split("path", r"\."), -1).alias("ext"),
        F.col("source").cast("string").alias("source"),
        "problem",
    )


def list_files(
    spark: SparkSession,
    root: str,
    names: Iterable[str] = SCAN_EXCLUSIONS,
    patterns: Iterable[str] = (),
) -> DataFrame:
    """``(file, ext, source)`` of the files of a scan that could be read."""
    return scan(spark, root, names, patterns).filter("problem IS NULL").drop("problem")


def default_exclusions(names: Iterable[str] = ()) -> tuple[str, ...]:
    """The folders left out by default, and the user's own."""
    return tuple(dict.fromkeys((*DEFAULT_EXCLUSIONS, *names)))


def readable(files: DataFrame) -> DataFrame:
    """Files whose text is valid UTF-8; the others are skipped."""
    return files.filter(F.is_valid_utf8("source"))


def unreadable(files: DataFrame) -> DataFrame:
    """Files whose bytes are not valid UTF-8."""
    return files.filter(~F.is_valid_utf8("source"))


def rejects(scanned: DataFrame) -> DataFrame:
    """``(file, problem)`` of what a scan found and could not read as text."""
    bad = F.when(~F.is_valid_utf8("source"), F.lit("the text is not valid UTF-8"))
    return scanned.select("file", F.coalesce("problem", bad).alias("problem")).filter("problem IS NOT NULL")


def first_files(files: DataFrame, count: int) -> DataFrame:
    """The first ``count`` files in path order: an opt-in report size, never a default."""
    return files.orderBy("file").limit(count)


def with_content(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """Paths of the files that hold at least one block or model."""
    return blocks.select("file").unionByName(models.select("file")).distinct()
