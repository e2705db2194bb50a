"""Commands: ``python -m loomwright index | graph | questions | tasks | annotate``.

Tables are folders of Spark's part files, by paths that the executors reach. Each command prints one line of JSON for what it wrote.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import annotate, code_graph
from .sources import code_index, files, sinks

#: Columns that keep the order of rows, besides those of the schemas.
SYMBOLS = schemas.SYMBOLS + ", file_ord LONG, sym_ord LONG"
IMPORTS = schemas.IMPORTS + ", file_ord LONG"


def subfolders(path: str) -> list[str]:
    """Names of the folders in a folder, sorted."""
    store, at = files.store_of(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=False))
    return sorted(i.base_name for i in found if i.type == fs.FileType.Directory)


def is_folder(path: str) -> bool:
    store, at = files.store_of(path)
    return store.get_file_info(at).type == fs.FileType.Directory


def say(**what) -> None:
    print(json.dumps(what, ensure_ascii=False))


def read_index(spark: SparkSession, symbols: str, imports: str) -> tuple[DataFrame, DataFrame]:
    return files.read_jsonl(spark, symbols, SYMBOLS), files.read_jsonl(spark, imports, IMPORTS)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    symbols, imports = code_index.index_repo(spark, a.repo_root)
    for name, rows in (("symbols", symbols), ("imports", imports)):
        sinks.write_jsonl(rows, f"{a.output_dir}/{name}.jsonl")
        say(table=name, path=f"{a.output_dir}/{name}.jsonl")


def export(spark: SparkSession, symbols: DataFrame, imports: DataFrame, out: str) -> None:
    """The graph as tables under ``out``, as one JSON document and as a page beside them."""
    sinks.write_graph(*code_graph.build_graph(symbols, imports), out)
    nodes, edges = files.read_graph(spark, out)
    sinks.write_graph_json(nodes, edges, f"{out}.json")
    sinks.write_graph_html(nodes, edges, f"{out}.html")
    stats = code_graph.graph_stats(nodes, edges).collect()  # a row for each type
    say(graph=out, stats={f"{r.what}:{r.kind}".rstrip(":"): r.n for r in stats})


def graph(spark: SparkSession, a: argparse.Namespace) -> None:
    if not (a.process_all or a.repo_name):
        export(spark, *read_index(spark, a.symbols, a.imports), a.out_prefix)
        return
    if not is_folder(a.repos_root):
        say(warning=f"no folder {a.repos_root}")
        return
    there = subfolders(a.repos_root)
    wanted = there if a.process_all else [a.repo_name]
    if not wanted or set(wanted) - set(there):
        say(warning=f"no such repository under {a.repos_root}")
        return
    for repo in wanted:
        out = f"{a.processed_root}/{repo}"
        found = code_index.ensure_index(spark, f"{a.repos_root}/{repo}", f"{out}/index/symbols", f"{out}/index/imports", a.force_reindex)
        export(spark, *found, f"{out}/graph")


def questions(spark: SparkSession, a: argparse.Namespace) -> None:
    def write(of: str, path: str) -> None:
        sinks.write_jsonl(code_graph.multihop_questions(*files.read_graph(spark, of)), path)
        say(graph=of, questions=files.read_jsonl(spark, path, schemas.QA).count(), path=path)

    if a.graph:
        write(a.graph, a.output or f"{a.graph.rstrip('/').rpartition('/')[0] or '.'}/{a.qa_name}")
        return
    if not is_folder(a.dataset_dir):
        raise FileNotFoundError(a.dataset_dir)
    done = [r for r in subfolders(a.dataset_dir) if is_folder(f"{a.dataset_dir}/{r}/{a.graph_name}")]
    for repo in done:
        write(f"{a.dataset_dir}/{repo}/{a.graph_name}", f"{a.dataset_dir}/{repo}/{a.qa_name}")
    say(repositories=len(done))


def tasks(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_jsonl(code_graph.static_tasks(*read_index(spark, f"{a.index_dir}/symbols.jsonl", f"{a.index_dir}/imports.jsonl")), a.output)
    say(path=a.output)


def backend_of(a: argparse.Namespace) -> Callable[[], annotate.Backend]:
    """A loader of the backend that ``module:factory`` names, called in each worker with the options of the model."""
    options = {"model": a.model, "temperature": a.temperature, "max_tokens": a.max_tokens, "top_p": a.top_p}
    module, _, factory = a.backend.partition(":")
    return lambda: getattr(importlib.import_module(module), factory)(**options)


def run_annotate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_jsonl(spark, a.input, schemas.QA)
    if a.limit > 0:
        rows = rows.orderBy("id").limit(a.limit)
    good, bad = f"{a.output_dir}/cot_dataset.jsonl", f"{a.output_dir}/cot_rejected.jsonl"
    stats = sinks.write_routed(annotate.annotate(rows, backend_of(a)), F.col("is_correct"), good, bad)
    stats = stats.select(F.lit(a.input).alias("input"), F.lit(a.backend).alias("backend"), F.lit(a.model).alias("model"), "*")
    sinks.write_jsonl(stats, f"{a.output_dir}/cot_stats.json")
    say(**stats.first().asDict())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomwright")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        return p

    p = command("index", index)
    p.add_argument("--repo-root", required=True)
    p.add_argument("--output-dir", required=True)

    p = command("graph", graph)
    p.add_argument("--symbols", default="index/symbols.jsonl")
    p.add_argument("--imports", default="index/imports.jsonl")
    p.add_argument("--out-prefix", default="graph")
    p.add_argument("--repos-root", default="repos", help="folder of repositories, for --repo-name and --process-all")
    p.add_argument("--processed-root", default="processed_data")
    p.add_argument("--repo-name")
    p.add_argument("--process-all", action="store_true")
    p.add_argument("--force-reindex", action="store_true")

    p = command("questions", questions)
    p.add_argument("--graph", help="folder of one graph's tables")
    p.add_argument("--output")
    p.add_argument("--dataset-dir", default="processed_data", help="folder of processed repositories, without --graph")
    p.add_argument("--graph-name", default="graph")
    p.add_argument("--qa-name", default="multi_hop_qas_en_unique.jsonl")

    p = command("tasks", tasks)
    p.add_argument("--index-dir", required=True)
    p.add_argument("--output", required=True)

    p = command("annotate", run_annotate)
    p.add_argument("--input", required=True)
    p.add_argument("--output-dir", default=".")
    p.add_argument("--backend", required=True, help="module:factory of the language model")
    p.add_argument("--model", required=True)
    p.add_argument("--temperature", type=float, default=0.3)
    p.add_argument("--max_tokens", type=int, default=512)
    p.add_argument("--top_p", type=float, default=0.9)
    p.add_argument("--limit", type=int, default=0, help="0 for all")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("loomwright").getOrCreate(), a)


if __name__ == "__main__":
    main()
