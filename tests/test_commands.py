"""The commands, one after the other, on a repository of two files."""

import json

import pytest

from loomwright import __main__ as commands
from loomwright import schemas
from loomwright.operators import annotate
from loomwright.sources import files, sinks


class Fixed(annotate.Echo):
    """Answers as told by the model's name."""

    def __init__(self, model, temperature, max_tokens, top_p):
        super().__init__(f"<reasoning>r</reasoning><final>{model}</final>")


def said(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_commands(spark, tmp_path, capsys):
    root = tmp_path / "repos" / "mini"
    root.mkdir(parents=True)
    (root / "core.py").write_text("import os\n\ndef load(p):\n    '''</script>'''\n    return os.path.join(p)\n")
    (root / "util.py").write_text("from core import load\n\ndef run(p):\n    return load(p)\n")
    at = str(tmp_path)
    commands.main(["index", "--repo-root", str(root), "--output-dir", f"{at}/index"])
    commands.main(["graph", "--symbols", f"{at}/index/symbols.jsonl", "--imports", f"{at}/index/imports.jsonl", "--out-prefix", f"{at}/graph"])
    commands.main(["graph", "--repos-root", f"{at}/repos", "--processed-root", f"{at}/done", "--process-all"])
    commands.main(["graph", "--repos-root", f"{at}/repos", "--processed-root", f"{at}/done", "--repo-name", "none"])
    by_index, by_repo, missing = said(capsys)[2:]
    assert by_index["stats"] == by_repo["stats"] and by_index["stats"]["node_type:Function"] == 2 and "warning" in missing
    page = (tmp_path / "graph.html").read_text()
    assert page.count("</script>") == 1 and sinks.COLOURS["Function"] in page
    assert len(json.loads((tmp_path / "graph.json").read_text())["nodes"]) == by_index["stats"]["nodes"]

    commands.main(["questions", "--graph", f"{at}/graph", "--output", f"{at}/qa.jsonl"])
    commands.main(["questions", "--dataset-dir", f"{at}/done"])
    one, each, total = said(capsys)
    assert one["questions"] == each["questions"] > 0 and total == {"repositories": 1}
    commands.main(["tasks", "--index-dir", f"{at}/index", "--output", f"{at}/tasks.jsonl"])
    assert spark.read.json(f"{at}/tasks.jsonl").count() > 0

    qa = files.read_jsonl(spark, f"{at}/qa.jsonl", schemas.QA).orderBy("id")
    answer = qa.first().answer[0]
    right = qa.where(qa.answer[0] == answer).count()
    told = ["annotate", "--input", f"{at}/qa.jsonl", "--output-dir", f"{at}/cot", "--backend", "tests.test_commands:Fixed", "--model", answer]
    commands.main(told)
    commands.main([*told, "--limit", "1"])
    every, first = [x for x in said(capsys) if "kept" in x]
    assert every["kept"] == right and every["kept"] + every["rejected"] == one["questions"]
    assert (first["kept"], first["rejected"], first["kept_ratio"]) == (1, 0, 1.0)
    assert spark.read.json(f"{at}/cot/cot_dataset.jsonl").count() == 1


def test_options_are_needed(capsys):
    with pytest.raises(SystemExit):
        commands.parser().parse_args(["annotate", "--input", "x"])
    a = commands.parser().parse_args(["annotate", "--input", "x", "--backend", "m:f", "--model", "m"])
    assert (a.temperature, a.max_tokens, a.top_p, a.limit) == (0.3, 512, 0.9, 0)
