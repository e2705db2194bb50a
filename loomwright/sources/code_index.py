"""Index of Python sources: one row for each file and one for each definition.

Paths are listed on the driver and read in the executors, as Spark's file sources skip names that begin with ``_``.
A file that is empty, unreadable or does not parse gives no rows. ``file_ord`` is the rank of the path,
``sym_ord`` the place of a definition in its file in breadth-first order.
"""

from __future__ import annotations

import ast
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import IMPORTS, SYMBOLS

MAX_CALLS = 30
TEST_LIBRARIES = ("pytest", "unittest", "nose", "hypothesis")
_SYMBOL = "ARRAY<STRUCT<name: STRING, kind: STRING, parent: STRING, start_line: INT, end_line: INT, docstring: STRING, calls: ARRAY<STRING>, decorators: ARRAY<STRING>>>"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def list_python_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), uri and file_ord of all ``*.py`` files under root."""
    store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    found = sorted(i.path for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".py"))
    rows = [(os.path.relpath(p, base), p, k) for k, p in enumerate(found)]
    return spark.createDataFrame(rows, "path string, location string, file_ord long").withColumn("root", F.lit(root if "://" in root else "file:///"))


def read_text(files: DataFrame) -> DataFrame:
    """Adds content: UTF-8, or an empty string where a file cannot be read so."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            texts = []
            for root, location in zip(t["root"], t["location"], strict=True):
                try:
                    with fs.FileSystem.from_uri(root)[0].open_input_stream(location) as f:
                        texts.append(f.read().decode("utf-8"))
                except (OSError, UnicodeDecodeError):
                    texts.append("")
            yield t[["path", "location", "file_ord"]].assign(content=texts)

    return files.mapInPandas(read, "path string, location string, file_ord long, content string")


def imported(tree: ast.AST) -> list[str]:
    out: list[str] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.append(node.module)
    return out


def last_name(node: ast.AST) -> str | None:
    """A name, or the last part of a dotted one."""
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def called(node: ast.AST) -> list[str]:
    names = (last_name(n.func) for n in ast.walk(node) if isinstance(n, ast.Call))
    return [n for n in names if n is not None]


def definitions(tree: ast.AST) -> list[dict]:
    """Functions and classes at any depth; parent is the named node whose body holds them."""
    holder = {id(child): getattr(node, "name", None) for node in ast.walk(tree) if isinstance(getattr(node, "body", None), list) for child in node.body}
    return [
        {
            "name": n.name,
            "kind": "Class" if isinstance(n, ast.ClassDef) else "Function",
            "parent": holder.get(id(n)),
            "start_line": n.lineno,
            "end_line": n.end_lineno,
            "docstring": ast.get_docstring(n),
            "calls": called(n),
            "decorators": [last_name(d) for d in n.decorator_list],
        }
        for n in ast.walk(tree)
        if isinstance(n, _DEFS)
    ]


def parse_sources(texts: DataFrame) -> DataFrame:
    """path, location, file_ord, imports, symbols, test_names of each file that parses."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for row in t.itertuples(index=False):
                try:
                    tree = ast.parse(row.content) if row.content else None
                except (SyntaxError, ValueError, RecursionError):
                    tree = None
                if tree is not None:
                    # Coroutines do not count as tests by their name.
                    tests = any(isinstance(n, (ast.FunctionDef, ast.ClassDef)) and n.name.lower().startswith("test") for n in ast.walk(tree))
                    out.append((row.path, row.location, row.file_ord, imported(tree), definitions(tree), tests))
            yield pd.DataFrame(out, columns=["path", "location", "file_ord", "imports", "symbols", "has_tests"])

    return texts.mapInPandas(parse, f"path string, location string, file_ord long, imports array<string>, symbols {_SYMBOL}, has_tests boolean")


def module_name(path: Column) -> Column:
    """Dotted path without its extension; ``__init__`` stays."""
    return F.translate(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")


def test_flag(path: Column, imports: Column, has_tests: Column) -> Column:
    libraries = F.exists(imports, lambda i: F.lit(False) | i.startswith(TEST_LIBRARIES[0]) | i.startswith(TEST_LIBRARIES[1]) | i.startswith(TEST_LIBRARIES[2]) | i.startswith(TEST_LIBRARIES[3]))
    return F.contains(F.lower(path), F.lit("test")) | libraries | has_tests


def index_sources(parsed: DataFrame, flag_by: str = "path") -> tuple[DataFrame, DataFrame]:
    """symbols and imports; ``flag_by`` is path (relative, the default) or location (absolute, which marks all of a checkout below a folder named so)."""
    files = parsed.withColumn("module", module_name(F.col("path")))
    symbols = files.select("path", "module", "file_ord", F.posexplode("symbols").alias("sym_ord", "s")).select(
        F.concat_ws("::", "module", "s.name").alias("symbol_id"), "path", "module", "s.name", "s.kind", "s.parent", "s.start_line", "s.end_line", "s.docstring",
        F.slice("s.calls", 1, MAX_CALLS).alias("calls"), "s.decorators", F.size("s.calls").alias("num_calls"), "file_ord", F.col("sym_ord").cast("long").alias("sym_ord"),
    )
    imports = files.select(
        "path", "module", "imports", F.size("symbols").alias("num_defs"), F.size("imports").alias("num_imports"), test_flag(F.col(flag_by), F.col("imports"), F.col("has_tests")).alias("has_test_flag"), "file_ord"
    )
    return symbols, imports


def index_repo(spark: SparkSession, root: str, flag_by: str = "path") -> tuple[DataFrame, DataFrame]:
    """symbols and imports of a folder of Python sources."""
    return index_sources(parse_sources(read_text(list_python_files(spark, root))), flag_by)


def index_repos(spark: SparkSession, roots: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """As index_repo for several folders, with a column repo of the folder's name."""
    parts = [[t.withColumn("repo", F.lit(os.path.basename(r.rstrip("/")))) for t in index_repo(spark, r)] for r in sorted(roots)]
    symbols, imports = parts[0]
    for s, i in parts[1:]:
        symbols, imports = symbols.unionByName(s), imports.unionByName(i)
    return symbols, imports


def ensure_index(spark: SparkSession, root: str, symbols_path: str, imports_path: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read the index where both tables exist, else make and write it."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    exists = all(jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p)) for p in (symbols_path, imports_path))
    if force or not exists:
        for table, path in zip(index_repo(spark, root), (symbols_path, imports_path), strict=True):
            table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(symbols_path), spark.read.parquet(imports_path)


__all__ = ["IMPORTS", "SYMBOLS", "ensure_index", "index_repo", "index_repos", "index_sources", "list_python_files", "parse_sources", "read_text"]
