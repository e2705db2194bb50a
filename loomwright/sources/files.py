"""Tables from files by their kind, dataset registries, caches, result files and repository lists."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import reduce

from pyarrow import fs, ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import DatasetAttr, dataset_attr

#: Kind of table by a file's extension.
KINDS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def list_files(path: str) -> list[str]:
    """A file itself, or all files of a folder, sorted."""
    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    return sorted(f"{path.rstrip('/')}/{i.base_name}" for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File)


def kind_of(path: str) -> str:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in KINDS:
        raise ValueError(f"unknown kind of file: {path}")
    return KINDS[ext]


def read_files(spark: SparkSession, path: str, same_kind: bool = True) -> DataFrame:
    """A table of a file or folder; the first file's kind holds for all, and with ``same_kind`` others are an error."""
    files = list_files(path)
    if not files:
        raise FileNotFoundError(f"no files in {path}")
    kind = kind_of(files[0])
    if same_kind and {kind_of(f) for f in files} != {kind}:
        raise ValueError(f"files of more than one kind in {path}")
    if kind == "arrow":
        return reduce(DataFrame.unionByName, [read_arrow(spark, f) for f in files])
    reader = spark.read
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", True).csv(files)
    if kind == "json":
        # A .json file is one list, a .jsonl file a record a line.
        parts = [reader.option("multiLine", ext == ".json").json([f for f in files if f.endswith(ext)]) for ext in (".json", ".jsonl") if any(f.endswith(ext) for f in files)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return reader.format(kind).load(files) if kind == "parquet" else reader.text(files).withColumnRenamed("value", "text")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow file or stream, batch by batch in the executors; only its schema is read here."""
    store, at = store_of(path)

    def opened(f):
        try:
            return ipc.open_file(f)
        except Exception:  # not the file format: a stream
            f.seek(0)
            return ipc.open_stream(f)

    with store.open_input_file(at) as f:
        schema = opened(f).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def read(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                own, where = store_of(p)
                with own.open_input_file(where) as f:
                    r = opened(f)
                    yield from (r.get_batch(i) for i in range(r.num_record_batches)) if hasattr(r, "num_record_batches") else r

    return spark.createDataFrame([(path,)], "path string").mapInArrow(read, from_arrow_schema(schema))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Records by a given schema; blank lines are skipped, or an error where ``strict``."""
    if strict and not spark.read.text(path).where(F.trim("value") == "").isEmpty():
        raise ValueError(f"blank line in {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_stores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON tables of cloud stores (s3, gs, gcs), folders filtered to .json and .jsonl, put together."""
    scheme = {"s3": "s3a", "gcs": "gs"}
    moved = [f"{scheme.get(p.split('://')[0], p.split('://')[0])}://{p.split('://', 1)[1]}" if "://" in p else p for p in paths]
    return spark.read.option("pathGlobFilter", "*.json*").json(moved)


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def read_repos(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of all sub-folders of root, with a column repo."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{root.rstrip('/')}/*/{table}").withColumn("repo", F.regexp_extract(F.input_file_name(), rf"([^/]+)/{table}/[^/]*$", 1))


# ---- registries


def read_registry(path: str) -> dict[str, dict]:
    """The registry of a folder of datasets, ``dataset_info.json``."""
    store, at = store_of(path)
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


def lookup(names: list[str], registry: dict[str, dict], prefer: tuple[str, ...] = ("hf_hub_url", "ms_hub_url", "om_hub_url")) -> list[DatasetAttr]:
    """Attributes by name: hub entries first (in the order of ``prefer``), then scripts, cloud files and files."""
    out = []
    for name in names:
        if name not in registry:
            raise ValueError(f"dataset {name} is not in the registry")
        entry = registry[name]
        kinds = {"hf_hub_url": "hf_hub", "ms_hub_url": "ms_hub", "om_hub_url": "om_hub", "script_url": "script", "cloud_file_name": "cloud_file", "file_name": "file"}
        key = next((k for k in (*prefer, "script_url", "cloud_file_name", "file_name") if k in entry), None)
        if key is None:
            raise ValueError(f"dataset {name} has no source")
        out.append(dataset_attr(entry, load_from=kinds[key], dataset_name=entry[key]))
    return out


def datasets_for(registry: dict[str, dict], ranking: bool) -> list[str]:
    return [k for k, v in registry.items() if bool(v.get("ranking", False)) == ranking]


def check_stage(stage: str, attr: DatasetAttr) -> None:
    if attr.ranking != (stage == "rm"):
        raise ValueError("a ranking dataset is for preference stages, and only such a dataset")


#: Connectors for hubs: name of the kind to a function of (spark, attr). None is built in, as they need a network.
HUBS: dict[str, Callable[[SparkSession, DatasetAttr], DataFrame]] = {}


def load_dataset(spark: SparkSession, attr: DatasetAttr, folder: str) -> DataFrame:
    if attr.load_from == "file":
        return read_files(spark, f"{folder.rstrip('/')}/{attr.dataset_name}")
    if attr.load_from == "cloud_file":
        return read_json_stores(spark, [attr.dataset_name])
    if attr.load_from in HUBS:
        return HUBS[attr.load_from](spark, attr)
    raise NotImplementedError(f"no connector for {attr.load_from}; register one in HUBS")


def resolve_source(source: str, folder: str) -> dict[str, dict]:
    """Entries of the second engine: a yaml of datasets, a local file or folder, or the name of a hub dataset."""
    path = source if source.startswith("/") else f"{folder.rstrip('/')}/{source}"
    if source.endswith((".yaml", ".yml")):
        entries: dict[str, dict] = {}
        store, at = store_of(path)
        with store.open_input_stream(at) as f:
            for line in f.read().decode().splitlines():
                if line.strip() and not line.startswith((" ", "#")):
                    name = line.split(":")[0].strip()
                    entries[name] = {}
                elif ":" in line and not line.strip().startswith("#"):
                    k, v = line.strip().split(":", 1)
                    entries[name][k] = v.strip().strip("'\"")
        return entries
    store, at = store_of(path)
    return {"default": {"file_name": source} if store.get_file_info(at).type != fs.FileType.NotFound else {"hf_hub_url": source}}


def read_v1(spark: SparkSession, path: str) -> DataFrame:
    """As read_files, but files of other kinds than the first's are not an error."""
    return read_files(spark, path, same_kind=False)


def has_tokenized(path: str) -> bool:
    store, at = store_of(path)
    return store.get_file_info(at).type == fs.FileType.Directory and bool(store.get_file_info(fs.FileSelector(at)))


def tokenized_or(spark: SparkSession, path: str | None, make: Callable[[], DataFrame]) -> DataFrame:
    """A cached table of tokens where there is one, else the made one, which is then written."""
    if path is None:
        return make()
    if not has_tokenized(path):
        make().write.parquet(path)
    return spark.read.parquet(path)


# ---- logs, results, evaluation


def latest_log(rows: DataFrame) -> DataFrame:
    """The last row of a trainer log by its steps."""
    return rows.agg(F.max_by(F.struct(*rows.columns), "current_steps").alias("r")).select("r.*")


def log_tail(text: Column, most: int = 20_000) -> Column:
    return F.right(text, F.lit(most))


def latest_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """pattern, path of the newest file that fits each."""
    parts = [spark.read.format("binaryFile").load(p).select(F.lit(p).alias("pattern"), "path", "modificationTime") for p in patterns]
    return reduce(DataFrame.union, parts).groupBy("pattern").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def candidate_repos(repos: DataFrame, n: int, done: list[str] = ()) -> DataFrame:
    """The n most starred repositories worth indexing: Python, above 100 stars, 500 to 20,000 KB, not archived, no fork, none of some topics."""
    topics = F.array(*map(F.lit, ("machine-learning", "deep-learning", "tutorial", "awesome-list", "education")))
    fits = (F.col("language") == "Python") & (F.col("stars") > 100) & F.col("size").between(500, 20_000) & ~F.col("archived") & ~F.col("fork")
    fits = fits & ~F.coalesce(F.arrays_overlap("topics", topics), F.lit(False)) & ~F.col("name").isin(list(done))
    return repos.where(fits).orderBy(F.desc("stars"), "name").limit(n)


def read_eval(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """question, A to D, answer, subject, category of an evaluation task with one file for each subject and a mapping.json."""
    mapping = read_registry(f"{folder.rstrip('/')}/mapping.json")
    names = spark.createDataFrame([(k, v["name"], v["category"]) for k, v in mapping.items()], "subject string, subject_name string, category string")
    rows = spark.read.csv(f"{folder.rstrip('/')}/{split}", schema="question STRING, A STRING, B STRING, C STRING, D STRING, answer STRING").withColumn("subject", F.regexp_extract(F.input_file_name(), rf"([^/]+?)(_{split})?\.csv$", 1))
    return rows.join(F.broadcast(names), "subject")  # one row for each subject of the mapping, which is on the driver
