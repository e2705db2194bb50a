"""The code graph: nodes and edges from an index, multi-hop questions and static tasks.

Every step is a relational plan over symbols, imports, nodes and edges; ``ord`` columns carry the order in which rows came, as
ids, winners of repeated keys and first positions follow it. Only the search with a visited set shared
by all branches runs in Python, one bounded neighbourhood of a start at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

TEST, FUNCTION = "Test", "Function"
#: Neighbours of a node in a block, and pairs of neighbours in a task.
BLOCK, PAIRS = 1024, 1 << 22
NODE_ATTRIBUTES = ("node_type", "name", "path", "module", "symbol_id", "start_line", "end_line", "docstring", "num_calls", "decorators", "num_defs", "num_imports", "has_test_flag")


# ---- construction


def is_test_context(path: Column, module: Column, name: Column, flag: Column) -> Column:
    inside = F.contains(path, F.lit("tests/")) | F.contains(path, F.lit("\\tests\\")) | F.contains(module, F.lit(".tests."))
    return F.coalesce(inside, F.lit(False)) | F.coalesce(name.startswith("test_"), F.lit(False)) | F.coalesce(flag, F.lit(False))


def typed_symbols(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Functions and classes with node_type and node id; ``ord`` is their order."""
    flags = imports.groupBy("path").agg(F.max_by("has_test_flag", "file_ord").alias("flag"))
    rows = symbols.where(F.col("kind").isin("Function", "Class")).join(flags, "path", "left")
    kind = F.when(is_test_context(F.col("path"), F.col("module"), F.col("name"), F.col("flag")), TEST).otherwise(FUNCTION)
    own = F.coalesce(F.nullif("symbol_id", F.lit("")), F.concat_ws("::", "module", "name"))
    order = F.struct("file_ord", "sym_ord")
    return rows.withColumns({"node_type": kind, "order": order}).withColumn("id", F.concat(F.lower("node_type"), F.lit(":"), own))


def upsert_nodes(parts: DataFrame) -> DataFrame:
    """One node for each id: every attribute from the last contribution that sets it, the place from the first."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(c) for c in NODE_ATTRIBUTES]
    return parts.groupBy("id").agg(*last, F.min("order").alias("order"))


def upsert_edges(edge_rows: DataFrame, *attributes: str) -> DataFrame:
    """One edge for each (src, dst): the sorted set of its types, other attributes from their last row, the place from the first."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(c) for c in attributes]
    return edge_rows.groupBy("src", "dst").agg(F.array_sort(F.collect_set("etype")).alias("etypes"), *last, F.min("order").alias("order"))


def resolve_calls(callers: DataFrame, functions: DataFrame) -> DataFrame:
    """The callers (src, module, callee, order) with dst: the last function of that name in the module, else an external."""
    index = functions.groupBy("module", "name").agg(F.max_by("id", "order").alias("target")).withColumnRenamed("name", "callee")
    return callers.join(index, ["module", "callee"], "left").withColumn("dst", F.coalesce("target", F.concat(F.lit("ext:"), "callee"))).drop("target")


def build_graph(symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges."""
    typed = typed_symbols(symbols, imports)
    place = lambda stage, *at: F.struct(F.lit(stage).alias("stage"), *[F.coalesce(a, F.lit(0)).cast("long").alias(f"at{i}") for i, a in enumerate((*at, *[F.lit(0)] * (3 - len(at))))])
    file_at, symbol_at = (F.col("file_ord"),), (F.col("order.file_ord"), F.col("order.sym_ord"))

    libs = imports.select("module", "file_ord", F.posexplode("imports").alias("k", "lib"))
    callers = typed.select(F.col("id").alias("src"), "module", "order", F.posexplode("calls").alias("k", "callee"))
    route = callers.where("callee = 'route'")
    calls = resolve_calls(callers.where("callee <> 'route'"), typed.select("id", "module", "name", "order"))
    marks = typed.select(F.col("id").alias("src"), "order", F.posexplode("decorators").alias("k", "mark")).where("mark <> ''")
    k = F.col("k")

    def node(rows: DataFrame, order: Column, id_: Column, **attributes: Column) -> DataFrame:
        return rows.select(id_.alias("id"), *[v.alias(c) for c, v in attributes.items()], order.alias("order"))

    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    c = F.col
    parts = [
        node(imports, place(1, *file_at), text("module:", c("module")), node_type=F.lit("Module"), name=c("module")),
        node(imports, place(1, *file_at, F.lit(0), F.lit(1)), text("file:", c("path")), node_type=F.lit("File"), path=c("path"), module=c("module"), num_defs=c("num_defs"), num_imports=c("num_imports"), has_test_flag=c("has_test_flag")),
        node(libs, place(1, *file_at, F.lit(1), k), text("lib:", c("lib")), node_type=F.lit("Library"), name=c("lib")),
        node(typed, place(2, *symbol_at), c("id"), **{a: c(a) for a in ("node_type", "name", "path", "module", "symbol_id", "start_line", "end_line", "docstring", "num_calls", "decorators")}),
        node(typed, place(2, *symbol_at, F.lit(1)), text("module:", c("module")), node_type=F.lit("Module"), name=c("module")),
        node(typed, place(2, *symbol_at, F.lit(2)), text("file:", c("path")), node_type=F.lit("File"), path=c("path"), module=c("module"), has_test_flag=F.coalesce(c("flag"), F.lit(False))),
        node(route, place(3, *symbol_at, k), F.lit("ext:route"), node_type=F.lit("ExternalAPI"), name=F.lit("route")),
        node(calls.where(c("dst") == text("ext:", c("callee"))), place(3, *symbol_at, k), c("dst"), node_type=F.lit("ExternalAPI"), name=c("callee")),
        node(marks, place(3, *symbol_at, k + 1_000_000), text("ext:", c("mark")), node_type=F.lit("ExternalAPI"), name=c("mark")),
    ]
    nodes = upsert_nodes(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))

    def edge(rows: DataFrame, order: Column, src: Column, dst: Column, etype: str) -> DataFrame:
        return rows.select(src.alias("src"), dst.alias("dst"), F.lit(etype).alias("etype"), order.alias("order"))

    edges = [
        edge(libs, place(1, *file_at, k), text("module:", c("module")), text("lib:", c("lib")), "IMPORTS"),
        edge(typed, place(2, *symbol_at), c("id"), text("module:", c("module")), "IN_MODULE"),
        edge(typed, place(2, *symbol_at, F.lit(1)), text("file:", c("path")), c("id"), "DEFINES"),
        edge(typed, place(2, *symbol_at, F.lit(2)), c("id"), text("file:", c("path")), "IN_FILE"),
        edge(route, place(3, *symbol_at, k), c("src"), F.lit("ext:route"), "DECORATED_BY"),
        edge(calls, place(3, *symbol_at, k), c("src"), c("dst"), "CALLS"),
        edge(marks, place(3, *symbol_at, k + 1_000_000), c("src"), text("ext:", c("mark")), "DECORATED_BY"),
    ]
    return nodes, upsert_edges(reduce(DataFrame.unionByName, edges))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (nodes, edges, node_type, etype), kind, n; edges count once for each of their types."""
    by_type = nodes.groupBy(F.coalesce("node_type", F.lit("UNK")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node_type").alias("what"), "kind", "n")
    by_etype = edges.select(F.explode("etypes").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("etype").alias("what"), "kind", "n")
    totals = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), F.lit("").alias("kind"), "n") for t, w in ((nodes, "nodes"), (edges, "edges"))]
    return reduce(DataFrame.unionByName, [by_type, by_etype, *totals])


def neighbours(edges: DataFrame, hops: int = 2) -> DataFrame:
    """node, neighbour, distance (1 or more) without regard to direction; a node is not its own neighbour."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("a", "b").where("a <> b"))
    reached = both.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), F.lit(1).alias("distance"))
    if hops > 1:
        reached = last = two_hops(both)
    for d in range(3, hops + 1):
        last = last.where(F.col("distance") == d - 1).join(both, F.col("neighbour") == F.col("a")).where("node <> b").select("node", F.col("b").alias("neighbour"), F.lit(d).alias("distance")).distinct()
        reached = reached.union(last)
    return reached.groupBy("node", "neighbour").agg(F.min("distance").alias("distance")) if hops > 2 else reached


def two_hops(both: DataFrame) -> DataFrame:
    """node, neighbour, distance 1 or 2, from edges (a, b) that are there in both directions.

    The neighbours of a node are dealt into blocks, and each two blocks of a node are multiplied in one place; tasks are as
    many as the pairs ask for. An end with one neighbour has no second way to any node and no edge to one at distance 2, so
    its pairs are given as they are found; only pairs of other ends are moved and made distinct.
    """
    c, degree = F.col, both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    tasks = int(degree.agg(F.coalesce(F.sum(c("n").cast("double") * c("n")), F.lit(0.0))).first()[0]) // PAIRS + 1
    blocks = F.ceil(c("of") / F.lit(BLOCK))
    dealt = both.join(degree.select(c("a").alias("b"), c("n").alias("of")), "b").join(degree, "a").select("a", "b", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("a"), blocks).alias("i"))
    kinds = [F.collect_list(F.when(x, c("a"))) for x in (c("n") == 1, c("n") > 1)]
    members = dealt.groupBy("b", "blocks", "i").agg(kinds[0].alias("single"), kinds[1].alias("other"))
    left = members.select("b", "i", "single", "other", F.explode(F.sequence(F.lit(0).cast("long"), c("blocks") - 1)).alias("j"))
    right = members.select("b", c("i").alias("j"), c("single").alias("single_2"), c("other").alias("other_2"))
    grid = left.join(right, ["b", "j"]).repartition(tasks, "b", "i", "j")

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("x").alias("node"), "y").select("node", F.explode("y").alias("neighbour"), F.lit(2).alias("distance")).where("node <> neighbour")

    ways = F.array(F.struct(c("single").alias("x"), F.concat("single_2", "other_2").alias("y")), F.struct(c("other").alias("x"), c("single_2").alias("y")))
    once = pairs(grid.select(F.explode(ways).alias("way")).select("way.x", "way.y"))
    more = pairs(grid.where("size(other) > 0 AND size(other_2) > 0").select(c("other").alias("x"), c("other_2").alias("y")))
    more = more.union(both.select("a", "b", F.lit(1))).groupBy("node", "neighbour").agg(F.min("distance").alias("distance"))
    return once.union(more)


def highlight(nodes: DataFrame, edges: DataFrame, item: str, column: str, values: list) -> DataFrame:
    """Ids of nodes whose column has one of the values, or of the ends of edges that do (item node or edge)."""
    if item == "node":
        return nodes.where(F.col(column).isin(values)).select("id")
    has = F.exists(column, lambda x: x.isin(values)) if column == "etypes" else F.col(column).isin(values)
    return edges.where(has).select(F.explode(F.array("src", "dst")).alias("id")).distinct()


# ---- questions with a unique answer


def shown_name(name: Column, id_: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), id_)


def edges_of(edges: DataFrame, etype: str, src: str, dst: str) -> DataFrame:
    """The distinct (src, dst) pairs whose types hold etype."""
    return edges.where(F.array_contains("etypes", etype)).select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct()


def files_of_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, path: files that define it, that it lies in, or that have its module's name; a file is its own."""
    paths = nodes.where("node_type = 'File' AND path <> ''").select(F.col("id").alias("file"), "path", F.col("module").alias("file_module"))
    defines = edges_of(edges, "DEFINES", "file", "node").join(paths, "file").select("node", "path")
    inside = edges_of(edges, "IN_FILE", "node", "file").join(paths, "file").select("node", "path")
    modules = nodes.where("node_type = 'Module'").select(F.col("id").alias("node"), "name").join(paths, F.col("name") == F.col("file_module")).select("node", "path")
    return reduce(DataFrame.union, [defines, inside, modules, paths.select("file", "path")]).distinct()


def dotted_suffixes(name: Column) -> Column:
    """All suffixes of a dotted name, and of the name without a last ``__init__``."""
    of = lambda x: F.transform(F.sequence(F.lit(1), F.size(F.split(x, r"\."))), lambda i: F.array_join(F.slice(F.split(x, r"\."), i, F.lit(1_000_000)), "."))
    bare = F.regexp_replace(name, r"\.__init__$", "")
    return F.array_distinct(F.concat(of(name), of(bare)))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading dotted parts two names share."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    same = F.zip_with(F.slice(x, F.lit(1), F.least(F.size(x), F.size(y))), F.slice(y, F.lit(1), F.least(F.size(x), F.size(y))), lambda p, q: p == q)
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def resolve_libraries(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """importer, library, module: the modules that an import names, best shared prefix with the importer first, packages with all they hold.

    ``imports`` has (importer, library) names, ``modules`` has a column name.
    """
    names = modules.select("name").where("name <> ''").distinct()
    suffixes = names.select("name", F.explode(dotted_suffixes(F.col("name"))).alias("suffix"))
    pairs = imports.select("importer", "library").distinct()
    direct = pairs.join(suffixes, F.col("library") == F.col("suffix")).select("importer", "library", "name")
    relative = pairs.where(~F.contains("library", F.lit(".")) & F.contains("importer", F.lit("."))).join(direct.select("importer", "library").distinct(), ["importer", "library"], "left_anti")
    parent = F.regexp_replace("importer", r"\.[^.]*$", "")
    relative = relative.withColumn("wanted", F.concat_ws(".", parent, "library")).join(suffixes, F.col("wanted") == F.col("suffix")).select("importer", "library", "name")
    scored = direct.union(relative).withColumn("score", common_prefix(F.col("importer"), F.col("name")))
    best = scored.withColumn("r", F.rank().over(Window.partitionBy("importer", "library").orderBy(F.desc("score")))).where("r = 1 AND score > 0").select("importer", "library", "name")
    best = cut(best)
    # A package brings its modules: each module is listed under all packages above it, so that this is an equi-join.
    parts = F.split("name", r"\.")
    above = names.where(F.size(parts) > 1).select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("package"))
    packages = best.where(F.col("name").endswith(".__init__")).select("importer", "library", F.regexp_replace("name", r"\.__init__$", "").alias("package"))
    members = packages.join(above, "package").select("importer", "library", "name")
    return best.union(members).distinct().withColumnRenamed("name", "module")


def unique_paths(paths: DataFrame, *key: str) -> DataFrame:
    """Paths whose key has exactly one path."""
    columns = [c for c in paths.columns if c not in key]
    return paths.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*columns)).alias("only")).where("n = 1").select(*key, "only.*")


def import_paths(nodes: DataFrame, edges: DataFrame, callee_types: tuple[str, ...]) -> DataFrame:
    """lib_name, callee_name, m, lib, f, x, f_type: module imports library, function in module, function calls a node of these types."""
    kinds = nodes.select("id", "node_type", shown_name(F.col("name"), F.col("id")).alias("shown"))
    modules = kinds.where("node_type = 'Module'").select(F.col("id").alias("m"))
    called = kinds.where(F.col("node_type").isin(*callee_types)).select(F.col("id").alias("x"), F.col("shown").alias("callee_name"))
    libs = kinds.select(F.col("id").alias("lib"), F.col("shown").alias("lib_name"))
    f_type = kinds.select(F.col("id").alias("f"), F.col("node_type").alias("f_type"))
    inside = edges_of(edges, "IN_MODULE", "f", "m").join(modules, "m")
    calls = edges_of(edges, "CALLS", "f", "x").join(called, "x")
    return edges_of(edges, "IMPORTS", "m", "lib").join(inside, "m").join(calls, "f").join(libs, "lib").join(f_type, "f")


def test_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ext_name, t, f, x: a test calls a function that calls an external."""
    kinds = nodes.select("id", "node_type", shown_name(F.col("name"), F.col("id")).alias("shown"))
    tests = kinds.where("node_type = 'Test'").select(F.col("id").alias("t"))
    functions = kinds.where(F.col("node_type").isin(FUNCTION, TEST)).select(F.col("id").alias("f"))
    externals = kinds.where("node_type = 'ExternalAPI'").select(F.col("id").alias("x"), F.col("shown").alias("ext_name"))
    first = edges_of(edges, "CALLS", "t", "f").join(tests, "t").join(functions, "f")
    return first.join(edges_of(edges, "CALLS", "f", "x").join(externals, "x"), "f")


def multihop_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The questions of all three patterns, numbered by pattern and by the places of the path's nodes."""
    nodes, edges = cut(nodes), cut(edges)
    files = cut(files_of_nodes(nodes, edges))
    module_names = nodes.where("node_type = 'Module'").select(F.col("id").alias("m"), F.col("name").alias("importer"))
    lib_names = nodes.where("node_type = 'Library'").select(F.col("id").alias("lib"), shown_name(F.col("name"), F.col("id")).alias("library"))
    lib_modules = resolve_libraries(cut(edges_of(edges, "IMPORTS", "m", "lib").join(module_names, "m").join(lib_names, "lib")), nodes.where("node_type = 'Module'"))
    module_files = module_names.join(files, F.col("m") == F.col("node")).select(F.col("importer").alias("module"), "path")
    lib_files = cut(lib_modules.join(module_files, "module").groupBy("importer", "library").agg(F.collect_set("path").alias("lib_files")))

    def pattern(number: int, callee: tuple[str, ...], ask: str) -> DataFrame:
        one = cut(unique_paths(import_paths(nodes, edges, callee), "lib_name", "callee_name"))
        one = one.join(module_names, "m").join(lib_files.withColumnRenamed("library", "lib_name"), ["importer", "lib_name"], "left")
        support = F.array(F.array("m", "lib", F.lit("IMPORTS")), F.array("f", "m", F.lit("IN_MODULE")), F.array("f", "x", F.lit("CALLS")))
        question = F.concat(F.lit("Which function is defined in a module that imports the library `"), "lib_name", F.lit(ask), "callee_name", F.lit("`?"))
        return one.select(F.lit(number).alias("pattern"), question.alias("question"), F.col("f").alias("found"), F.col("f_type").alias("answer_type"), F.array("m", "lib", "f", "x").alias("path"), support.alias("edges"), F.lit(3).alias("num_hops"), "lib_files")

    two = unique_paths(test_paths(nodes, edges), "ext_name")
    support = F.array(F.array("t", "f", F.lit("CALLS")), F.array("f", "x", F.lit("CALLS")))
    two = two.select(F.lit(2).alias("pattern"), F.concat(F.lit("Which test function calls a function that itself calls the external API `"), "ext_name", F.lit("`?")).alias("question"), F.col("t").alias("found"), F.lit(TEST).alias("answer_type"), F.array("t", "f", "x").alias("path"), support.alias("edges"), F.lit(2).alias("num_hops"), F.lit(None).cast("array<string>").alias("lib_files"))
    every = cut(pattern(1, ("ExternalAPI",), "`, and calls the external API `").unionByName(two).unionByName(pattern(3, (FUNCTION, TEST), "`, and calls another function named `")))

    near = every.select("pattern", "path", F.explode("path").alias("node")).join(files.withColumnRenamed("path", "file"), "node").groupBy("pattern", "path").agg(F.collect_set("file").alias("files"))
    places = every.select("pattern", "path", F.posexplode("path").alias("k", "node")).join(nodes.select(F.col("id").alias("node"), "order"), "node").groupBy("pattern", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "order"))), lambda x: x["order"]).alias("places"))
    out = every.join(near, ["pattern", "path"], "left").join(places, ["pattern", "path"])
    none = F.array().cast("array<string>")
    # Ids run over all questions: one number for each output row.
    number = F.row_number().over(Window.orderBy("pattern", "places"))
    return out.select(
        F.format_string("qa_%05d", number).alias("id"), "question", F.array("found").alias("answer"), "answer_type", F.struct("path", "edges").alias("graph_support"), "num_hops", F.lit(True).alias("verified"),
        F.array_sort(F.array_union(F.coalesce("files", none), F.coalesce("lib_files", none))).alias("relavant_files"),
    )


# ---- static tasks


def name_call_graph(symbols: DataFrame) -> DataFrame:
    """caller, callee, ord: calls of names that exactly one symbol row has, other than the caller itself."""
    only = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("symbol_id").alias("callee")).where("n = 1").select(F.col("name").alias("called"), "callee")
    calls = symbols.select(F.col("symbol_id").alias("caller"), F.struct("file_ord", "sym_ord").alias("order"), F.posexplode("calls").alias("k", "called"))
    return calls.join(only, "called").where("caller <> callee").select("caller", "callee", F.struct("order.file_ord", "order.sym_ord", "k").alias("ord"))


def last_symbols(symbols: DataFrame) -> DataFrame:
    """One row for each symbol_id, the last."""
    columns = [c for c in symbols.columns if c != "symbol_id"]
    return symbols.groupBy("symbol_id").agg(F.max_by(F.struct(*columns), F.struct("file_ord", "sym_ord")).alias("s")).select("symbol_id", "s.*")


def unique_terminal(start, follow: dict, most: int) -> list | None:
    """The one path from start to a node without successors; visited nodes are shared by all branches and do not hold the start."""
    seen, stack, ends = set(), [[start]], []
    while stack:
        path = stack.pop()
        onward = follow.get(path[-1])
        if not onward:
            ends.append(path)
            continue
        if len(path) < most:
            for node in onward:
                if node not in seen:
                    seen.add(node)
                    stack.append([*path, node])
    return ends[0] if len(ends) == 1 else None


def unique_chains(links: DataFrame, most: int) -> DataFrame:
    """start, chain: for each start with one terminal. ``links`` has src, dst, ord.

    Where each node on the way has one successor, chains grow backward from the terminals, a hop at a time. Only starts that
    come upon a node with more are searched.
    """
    c = F.col
    ends = cut(links.where("src IS NOT NULL").groupBy("src").agg(F.min("dst").alias("next"), F.max("dst").alias("last"), F.count_if(c("dst").isNull()).alias("nulls")))
    lone = (c("nulls") == 0) & (c("next") == c("last"))
    singles, forks = ends.where(lone).select("src", "next"), ends.where(~F.coalesce(lone, F.lit(False))).select("src")
    grown = singles.join(ends.select(c("src").alias("known")), c("next") == c("known"), "left_anti").select(c("src").alias("start"), F.array("src", "next").alias("chain"))
    chains = grown.limit(0) if most < 2 else grown
    for _ in range(most - 2):
        # A node has one chain at most, so the chains make the smaller side, and no key of theirs is repeated.
        after = grown.select(c("start").alias("known"), "chain").hint("shuffle_hash")
        grown = singles.join(after, c("next") == c("known")).select(c("src").alias("start"), F.concat(F.array("src"), "chain").alias("chain"))
        chains = chains.union(grown)
    if forks.isEmpty():
        return chains
    starts = before = forks
    for _ in range(most - 2):
        before = singles.join(before.select(c("src").alias("known")), c("next") == c("known")).select("src")
        starts = starts.union(before)
    return chains.union(searched_chains(cut(links.select("src", "dst", "ord")), cut(starts), most))


def searched_chains(first: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, chain: for each of the starts (src) with one terminal.

    The links within ``most`` hops of a start are joined hop by hop and searched together, one group for each start.
    """
    lists = first.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("onward"))
    reach = starts.select(F.col("src").alias("start"), F.col("src").alias("node"))
    frontier = reach
    for _ in range(most - 1):
        frontier = frontier.join(first, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        reach = reach.union(frontier)
    near = reach.distinct().join(lists, F.col("node") == F.col("src"))
    grouped = near.groupBy("start").agg(F.collect_list(F.struct("node", "onward")).alias("part"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for start, part in zip(t["start"], t["part"], strict=True):
                chain = unique_terminal(start, {p["node"]: list(p["onward"]) for p in part}, most)
                if chain is not None:
                    out.append((start, chain))
            yield pd.DataFrame(out, columns=["start", "chain"])

    return grouped.mapInPandas(search, "start string, chain array<string>")


def single(rows: DataFrame, target: str, *key: str) -> DataFrame:
    """Keys with exactly one distinct target."""
    return rows.groupBy(*key).agg(F.countDistinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")


def static_tasks(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """type, question, answer, ground_truth, reasoning_path, evidence, verified; first of each (question, answer)."""
    symbols, imports, c = cut(symbols), cut(imports), F.col
    info, calls = cut(last_symbols(symbols)), cut(name_call_graph(symbols))
    lit = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    none = F.lit(None).cast("array<string>")

    def task(rows, kind, question, answer, truth, path, evidence, order):
        pairs = [x for k, v in evidence.items() for x in (F.lit(k), v)]
        proof = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
        return rows.select(F.lit(kind).alias("type"), question.alias("question"), answer.alias("answer"), truth.alias("ground_truth"), path.alias("reasoning_path"), proof.alias("evidence"), F.lit(True).alias("verified"), order.cast("string").alias("order"))

    own = info.select(c("symbol_id").alias("caller"), c("name").alias("c_name"), c("module").alias("c_module"), c("path").alias("c_path"), c("parent").alias("c_parent"), c("kind").alias("c_kind"), F.format_string("%012d.%012d", "file_ord", "sym_ord").alias("at"))
    target = info.select(c("symbol_id").alias("callee"), c("name").alias("t_name"), c("module").alias("t_module"), c("parent").alias("t_parent"), c("path").alias("t_path"))
    linked = cut(calls.select("caller", "callee").join(own, "caller").join(target, "callee"))

    chains = unique_chains(calls.select(c("caller").alias("src"), c("callee").alias("dst"), "ord"), 5).where("size(chain) > 1")
    chains = cut(chains)
    names = chains.select("start", F.posexplode("chain").alias("k", "symbol_id")).join(info.select("symbol_id", "name"), "symbol_id").groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("names"))
    ended = chains.join(names, "start").withColumn("callee", F.element_at("chain", -1)).join(own, c("start") == c("caller")).join(target, "callee")
    out = [task(ended, "call_chain_reasoning", lit("When calling `", c("c_name"), "`, which function is ultimately invoked?"), c("t_name"), c("callee"), c("names"), {"start_path": c("c_path"), "end_path": c("t_path")}, lit("1", c("at")))]

    cross = single(linked.where("t_module <> c_module"), "t_module", "caller", "c_name", "c_path", "at")
    out.append(task(cross, "cross_module_reasoning", lit("Which module's function does `", c("c_name"), "` call?"), c("t_module"), c("t_module"), none, {"path": c("c_path")}, lit("2", c("at"))))

    wanted = imports.groupBy("module").agg(F.max_by("imports", "file_ord").alias("imports")).select(c("module").alias("c_module"), F.posexplode("imports").alias("k", "imported"))
    named = single(linked.join(wanted, "c_module").where(c("t_module").startswith(c("imported"))), "t_name", "caller", "c_module", "c_path", "imported", "k", "at")
    out.append(task(named, "import_call_reasoning", lit("In module `", c("c_module"), "`, which function from imported module `", c("imported"), "` is called?"), c("t_name"), c("t_name"), none, {"path": c("c_path"), "import": c("imported")}, lit("3", c("at"), F.format_string(".%06d", "k"))))

    methods = linked.where("c_kind = 'Function' AND c_parent <> '' AND t_parent <> '' AND t_parent <> c_parent").withColumn("method", F.concat_ws(".", "t_parent", "t_name"))
    methods = single(methods, "method", "caller", "c_name", "c_parent", "c_path", "at")
    out.append(task(methods, "class_method_dependency", lit("Which class method does `", c("c_parent"), ".", c("c_name"), "` depend on?"), c("method"), c("method"), none, {"path": c("c_path"), "parent": c("c_parent")}, lit("4", c("at"))))

    # The called name first, as an equi-join; the module's prefix is left as a filter.
    tests = imports.where("has_test_flag").select(c("module").alias("test_module"), "file_ord", F.posexplode("imports").alias("k", "imported")).withColumnRenamed("file_ord", "f")
    cases = symbols.where(c("name").startswith("test")).select(c("module").alias("test_module"), c("symbol_id").alias("test_id"), c("name").alias("test_name"), c("path").alias("test_path"), F.format_string("%012d", "sym_ord").alias("s"), F.explode(F.array_distinct("calls")).alias("called"))
    parts = symbols.select(c("name").alias("called"), c("module").alias("impl_module"), c("path").alias("impl_path"), F.format_string("%012d.%012d", "file_ord", "sym_ord").alias("i"))
    covered = cases.join(parts, "called").join(tests, "test_module").where(c("impl_module").startswith(c("imported")) & (c("called") != c("test_name")))
    out.append(task(covered, "test_coverage_reasoning", lit("Which test function verifies the behavior of `", c("called"), "`?"), c("test_name"), c("test_id"), none, {"test_path": c("test_path"), "impl_path": c("impl_path")}, lit("5", F.format_string("%012d.%06d", "f", "k"), c("s"), c("i"))))

    last = imports.groupBy("module").agg(F.max_by("imports", "file_ord").alias("imports"), F.min("file_ord").alias("f"))
    ways = unique_chains(last.select(c("module").alias("src"), F.posexplode("imports").alias("ord", "dst")), 3).where("size(chain) > 2").join(last.select(c("module").alias("start"), "f"), "start")
    out.append(task(ways, "import_chain_reasoning", lit("Through which modules does `", F.element_at("chain", 1), "` indirectly import `", F.element_at("chain", -1), "`?"), F.array_join(F.slice("chain", F.lit(2), F.size("chain")), " → "), F.element_at("chain", -1), c("chain"), {}, lit("6", F.format_string("%012d", "f"))))

    every = cut(reduce(DataFrame.unionByName, out))
    rest = [x for x in every.columns if x not in ("question", "answer", "order")]
    first = every.groupBy("question", "answer").agg(F.min_by(F.struct(*rest), "order").alias("t"))
    return first.select("t.type", "question", "answer", *[f"t.{x}" for x in rest if x != "type"])
