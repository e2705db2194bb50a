"""A repository of three files, with counts derived by hand."""

import pytest
from pyspark.sql import functions as F

from loomwright.operators import code_graph
from loomwright.sources import code_index

FILES = {
    "pkg/core.py": "import os\nfrom pkg.util import helper\n\ndef run(x):\n    return helper(x)\n\ndef load(p):\n    data = run(p)\n    return os.path.join(p, data)\n",
    "pkg/util.py": "def helper(x):\n    return str(x).strip()\n",
    "pkg/__init__.py": "",
    "pkg/bad.py": "def (",
    "qa_checks/test_core.py": "import pytest\nfrom pkg.core import run\n\ndef test_run():\n    assert run(1)\n    check(run)\n\ndef check(fn):\n    return fn\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("mini")
    for path, text in FILES.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    symbols, imports = code_index.index_repo(spark, str(root))
    return symbols.cache(), imports.cache()


@pytest.fixture(scope="module")
def graph(index):
    nodes, edges = code_graph.build_graph(*index)
    return nodes.cache(), edges.cache()


def test_index(index):
    symbols, imports = index
    got = {r.name: (r.symbol_id, r.calls, r.start_line, r.end_line) for r in symbols.collect()}
    assert got["run"] == ("pkg.core::run", ["helper"], 4, 5) and got["load"][1] == ["run", "join"]
    assert got["helper"][1] == ["strip", "str"] and got["test_run"][1:] == (["run", "check"], 4, 6)
    assert {r.path: (r.imports, r.has_test_flag) for r in imports.collect()} == {"pkg/core.py": (["os", "pkg.util"], False), "pkg/util.py": ([], False), "qa_checks/test_core.py": (["pytest", "pkg.core"], True)}


def test_special_names_are_read(spark, tmp_path):
    for name in ("__init__.py", "_priv.py", "core.py"):
        (tmp_path / name).write_text("class A:\n    @route('/')\n    @cache\n    def m(self):\n        pass\n")
    symbols, imports = code_index.index_repo(spark, str(tmp_path))
    assert sorted(r.module for r in imports.collect()) == ["__init__", "_priv", "core"]
    m = symbols.where("name = 'm' AND module = 'core'").first()
    assert m.parent == "A" and m.decorators == [None, "cache"] and m.kind == "Function"


def test_graph(graph):
    nodes, edges = graph
    stats = {(r.what, r.kind): r.n for r in code_graph.graph_stats(nodes, edges).collect()}
    assert stats == {
        ("nodes", ""): 20, ("edges", ""): 26, ("node_type", "Module"): 3, ("node_type", "File"): 3, ("node_type", "Library"): 4, ("node_type", "Function"): 3, ("node_type", "Test"): 2, ("node_type", "ExternalAPI"): 5,
        ("etype", "IMPORTS"): 4, ("etype", "IN_MODULE"): 5, ("etype", "DEFINES"): 5, ("etype", "IN_FILE"): 5, ("etype", "CALLS"): 7,
    }
    calls = {(r.src, r.dst) for r in edges.where(F.array_contains("etypes", "CALLS")).collect()}
    assert ("function:pkg.core::load", "function:pkg.core::run") in calls and ("test:qa_checks.test_core::test_run", "ext:run") in calls
    file = nodes.where("id = 'file:pkg/core.py'").first()
    assert file.num_defs == 2 and file.num_imports == 2  # set once, not lost by the later contribution


def test_questions(graph):
    got = code_graph.multihop_questions(*graph).collect()
    assert len(got) == 10 and sum(r.num_hops == 3 for r in got) == 10
    assert sorted(r.id for r in got) == [f"qa_{i:05d}" for i in range(1, 11)]
    one = next(r for r in got if "`pkg.util`" in r.question and "`helper`" in r.question)
    assert one.relavant_files == ["pkg/core.py", "pkg/util.py"] and one.answer == ["function:pkg.core::run"]


def test_tasks(index):
    got = code_graph.static_tasks(*index).collect()
    kinds = {}
    for r in got:
        kinds[r.type] = kinds.get(r.type, 0) + 1
    assert kinds == {"call_chain_reasoning": 2, "cross_module_reasoning": 2, "import_call_reasoning": 2, "test_coverage_reasoning": 1}


def test_visited_is_shared():
    assert code_graph.unique_terminal("A", {"A": ["B", "C"], "B": ["D"], "C": ["D"]}, 5) == ["A", "C", "D"]
    assert code_graph.unique_terminal("A", {"A": ["B"], "B": ["A"]}, 5) is None


def test_library_resolution(spark):
    modules = spark.createDataFrame([(m,) for m in ("src.flask.__init__", "src.flask.app", "src.flask.cli", "docs.conf")], "name string")
    imports = spark.createDataFrame([("src.flask.app", "flask"), ("src.flask.app", "cli"), ("docs.conf", "flask")], "importer string, library string")
    got = {}
    for r in code_graph.resolve_libraries(imports, modules).collect():
        got.setdefault((r.importer, r.library), set()).add(r.module)
    assert got == {("src.flask.app", "flask"): {"src.flask.__init__", "src.flask.app", "src.flask.cli"}, ("src.flask.app", "cli"): {"src.flask.cli"}}


def test_upsert_keeps_set_types_and_last_attributes(spark):
    rows = spark.createDataFrame([("f", "c", "CALLS", 1, "a"), ("f", "c", "DECORATED_BY", 2, None), ("f", "c", "CALLS", 3, "b")], "src string, dst string, etype string, order int, note string")
    (r,) = code_graph.upsert_edges(rows, "note").collect()
    assert r.etypes == ["CALLS", "DECORATED_BY"] and r.note == "b" and r.order == 1


def test_neighbours_and_highlight(spark):
    edges = spark.createDataFrame([("a", "b", ["CALLS"]), ("b", "c", ["IMPORTS"])], "src string, dst string, etypes array<string>")
    assert {(r.node, r.neighbour): r.distance for r in code_graph.neighbours(edges).collect()} == {("a", "b"): 1, ("b", "a"): 1, ("b", "c"): 1, ("c", "b"): 1, ("a", "c"): 2, ("c", "a"): 2}
    assert {r.id for r in code_graph.highlight(None, edges, "edge", "etypes", ["IMPORTS"]).collect()} == {"b", "c"}


def test_neighbours_of_hubs_are_dealt_out(spark, monkeypatch):
    import random

    monkeypatch.setattr(code_graph, "BLOCK", 8, raising=False)
    monkeypatch.setattr(code_graph, "PAIRS", 2000, raising=False)
    rng = random.Random(4)
    edges = [(f"s{i}", "hub", ["X"]) for i in range(150)] + [("hub", "top", ["X"]), ("top", "hub", ["X"]), ("hub", "hub", ["X"]), (None, "hub", ["X"])]
    edges += [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", ["X"]) for _ in range(25)] + [(f"s{i}", "top", ["X"]) for i in range(20)]
    near = {}
    for a, b, _ in edges:
        if a and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(a, c): 2 for a in near for b in near[a] for c in near[b] if a != c} | {(a, b): 1 for a in near for b in near[a]}
    got = code_graph.neighbours(spark.createDataFrame(edges, "src string, dst string, etypes array<string>")).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) and {(r.node, r.neighbour): r.distance for r in got} == want
    tasks = [r.task for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < len(got) / 4


def test_neighbours_three_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c")], "src string, dst string")
    got = {(r.node, r.neighbour): r.distance for r in code_graph.neighbours(edges, 3).collect()}
    assert got[("a", "e")] == got[("b", "e")] == 3 and got[("a", "d")] == 2 and got[("a", "b")] == 1 and len(got) == 20


def test_chains_without_forks_are_joined_only(spark):
    links = spark.createDataFrame([(f"{c}{i}", f"{c}{i + 1}", 0) for c in "abc" for i in range(8)] + [("x", "y", 0), ("y", "x", 0), ("z", "z", 0)], "src string, dst string, ord int")
    chains = code_graph.unique_chains(links, 5)
    assert "MapInPandas" not in chains._jdf.queryExecution().toString()
    assert {r.start: r.chain for r in chains.collect()} == {f"{c}{i}": [f"{c}{j}" for j in range(i, 9)] for c in "abc" for i in range(4, 8)}


@pytest.mark.parametrize("most", [2, 3, 5])
def test_chains_with_forks_are_searched(spark, most):
    import random

    rng = random.Random(most)
    links = [(f"n{rng.randrange(90)}", f"n{rng.randrange(110)}", i) for i in range(75)] + [("m1", "m2", 1), ("m1", "m2", 2), ("m0", "m1", 3), ("m3", None, 4), ("m4", "m3", 5), (None, "m0", 6)]
    follow = {}
    for src, dst, _ in links:
        if src:
            follow.setdefault(src, []).append(dst)
    want = {s: chain for s in follow if (chain := code_graph.unique_terminal(s, follow, most))}
    got = code_graph.unique_chains(spark.createDataFrame(links, "src string, dst string, ord int"), most).collect()
    assert len(got) == len(want) > 10 and {r.start: r.chain for r in got} == want
