"""Scalar functions as Column expressions: text clean-up, tags, answers, prompts, lengths."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def pystrip(c: Column) -> Column:
    """Without white space at both ends, not blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def truthy(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


@F.pandas_udf(StringType())
def pyjson(texts: pd.Series) -> pd.Series:
    """JSON text written anew with blanks after commas and colons; key order and non-ASCII letters stay."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False))


# ---- tags and answers


def tag(c: Column, name: str) -> Column:
    """What stands in the first <name> element, stripped; empty where there is none."""
    inner = r"\s*(.+?)\s*" if name == "final" else r"(.*?)"
    return pystrip(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?is)<{name}>{inner}</{name}>", 1))


def verified(prediction: Column, answer: Column, need_prediction: bool = False) -> Column:
    """Whether the answer is one item and holds the prediction."""
    ok = (F.size(answer) == 1) & F.array_contains(answer, prediction)
    return F.coalesce(ok & (prediction != "") if need_prediction else ok, F.lit(False))


def extract_answer(c: Column) -> Column:
    """The last ``\\boxed{}``, else what follows the last of the usual phrases (in lower case), else the last line."""
    boxed = F.regexp_extract_all(c, F.lit(r"\\boxed\{([^}]*)\}"), F.lit(1))
    low = F.lower(c)
    said = F.coalesce(*[F.when(F.size(x) > 0, F.element_at(x, -1)) for x in (F.regexp_extract_all(low, F.lit(p + r"\s*([^\n.]+)"), F.lit(1)) for p in ("the answer is", "answer:", "final answer:"))])
    line = F.element_at(F.split(pystrip(c), "\n"), -1)
    return pystrip(F.when(F.size(boxed) > 0, F.element_at(boxed, -1)).otherwise(F.coalesce(said, line)))


def normalize_answer(c: Column) -> Column:
    """Stripped, then without dollar signs and \\text{}."""
    return F.regexp_replace(F.replace(pystrip(c), F.lit("$"), F.lit("")), r"\\text\{([^}]*)\}", "$1")


def same_answer(a: Column, b: Column, equal=None) -> Column:
    """Equal after normalising, or as the given column function of both says."""
    exact = normalize_answer(a) == normalize_answer(b)
    return exact if equal is None else exact | equal(a, b)


def percent(c: Column) -> Column:
    """A share as per cent with one decimal, or N/A."""
    return F.when(c.isNotNull(), F.format_string("%.1f%%", c * 100)).otherwise("N/A")


def rewritten_question(c: Column) -> Column:
    """What follows the last ``Rewritten:``, on one line."""
    return F.replace(pystrip(F.substring_index(c, "Rewritten:", -1)), F.lit("\n"), F.lit(" "))


def suffixed_path(path: str, suffix: str) -> str:
    """The path with a suffix before its extension."""
    head, dot, ext = path.rpartition(".")
    return f"{head}{suffix}.{ext}" if dot and "/" not in ext else f"{path}{suffix}"


# ---- reasoning over graph paths

# Prompts and conversation texts that must equal those of the data this engine replaces.
COT_SYSTEM = "You are an expert code reasoning assistant. You must reason step by step over graph facts (nodes and labeled edges) to answer the question. Strictly follow the response format below."
COT_USER = """You are given a multi-hop question about a code knowledge graph and a set of supporting edges.

Question:
{question}

Graph support (edges):
{edges_json}

Instructions:
1) Think step by step using the edges only.
2) Output your reasoning inside <reasoning> ... </reasoning>.
3) Output the final answer as the EXACT node id string from the graph, inside <final> ... </final>.
4) The final answer must be a SINGLE node id string that exists in the graph_support answer set.

Response format (no extra text outside the tags):
<reasoning>...your step-by-step reasoning in English...</reasoning>
<final>node_type:module_or_symbol_id</final>
"""
NO_CODE = "```python\n# code snippet not available for this sample\n```\n"


def filled(template: str, **values: Column) -> Column:
    """A template with each ``{name}`` replaced by a column."""
    parts, rest = [], template
    while rest:
        at, name = min(((rest.find(f"{{{k}}}"), k) for k in values if f"{{{k}}}" in rest), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def edges_json(edges: Column) -> Column:
    """Edges [[src, dst, type], ...] as JSON with blanks after commas."""
    quoted = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    one = lambda e: F.concat(F.lit('["'), F.array_join(F.transform(e, quoted), '", "'), F.lit('"]'))
    return F.concat(F.lit("["), F.array_join(F.transform(edges, one), ", "), F.lit("]"))


def cot_prompt(question: Column, edges: Column) -> Column:
    return filled(COT_USER, question=question, edges_json=edges_json(edges))


def numbered(items: Column, prefix: str = "") -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(f". {prefix}"), x)), "\n")


def path_reasoning(path: Column, final: Column) -> Column:
    return F.concat(
        F.lit("We follow the multi-hop graph path:\n"), numbered(path, "Follow graph node: "), F.lit("\n\nThis path shows that the target function is `"), final,
        F.lit("`.\nTherefore, the final answer is the node indicated in the last hop."),
    )


def reasoning_chat(question: Column, path: Column, final: Column, code: Column, system: str) -> Column:
    """A conversation of system, user and assistant (from, value)."""
    shown = F.when(truthy(code).isNull() | (code == "N/A"), NO_CODE).otherwise(code)
    user = F.concat(F.lit("Question:\n"), question, F.lit("\n\nGraph Path:\n"), numbered(path), F.lit("\n\nRelevant Code Snippets:\n"), shown, F.lit("\nPlease answer with:\n<reasoning>...</reasoning>\n<final>node_id</final>"))
    said = F.concat(F.lit("<reasoning>"), path_reasoning(path, final), F.lit("</reasoning>\n<final>"), final, F.lit("</final>"))
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", said))


def code_snippet(path: Column, content: Column, start: Column, end: Column, most_lines: int = 400, most_chars: int = 4000) -> Column:
    """Lines start to end of a file in a fenced block; null for an empty file."""
    body = F.regexp_replace(content, r"\n$", "")
    lines = F.split(body, "\n")
    total = F.size(lines)
    first = F.when(start > 0, start).otherwise(1)
    last = F.greatest(F.when(end > 0, end).otherwise(total), first)
    last = F.least(last, first + most_lines - 1, total)
    first = F.greatest(F.least(first, last), F.lit(1))
    ended = (last < total) | content.endswith("\n")
    text = F.concat(F.array_join(F.slice(lines, first, last - first + 1), "\n"), F.when(ended, "\n").otherwise(""))
    text = F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars), F.lit("\n# ... truncated ...\n"))).otherwise(text)
    return F.when(F.length(content) > 0, F.concat(F.lit("File: "), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n```python\n"), text, F.lit("\n```")))


def code_nodes(answer: Column, path: Column) -> Column:
    """Answers, then functions and tests of the path, each once in this order."""
    return F.array_distinct(F.concat(answer, F.filter(path, lambda x: x.startswith("function:") | x.startswith("test:"))))


def code_context(questions, nodes, files):
    """Adds code_context to questions (id, answer, graph_support): the snippets of code_nodes, numbered as the nodes are, or N/A."""
    asked = questions.select("id", F.posexplode(code_nodes(F.col("answer"), F.col("graph_support.path"))).alias("k", "node"))
    found = asked.join(nodes.select(F.col("id").alias("node"), "node_type", "module", "path", "start_line", "end_line"), "node").join(files.select("path", "content"), "path")
    snippet = code_snippet(F.col("path"), F.col("content"), F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)))
    header = F.concat((F.col("k") + 1).cast("string"), F.lit(". "), "node", F.lit(" (type="), "node_type", F.lit(", module="), F.coalesce("module", F.lit("None")), F.lit(", file="), "path", F.lit(")\n"))
    parts = found.withColumn("s", snippet).where("s IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(header, "s").alias("s")))).alias("p"))
    context = F.coalesce(F.array_join(F.transform("p", lambda x: x["s"]), "\n\n"), F.lit("N/A"))
    return questions.join(parts, "id", "left").withColumn("code_context", context).drop("p")


# ---- lengths and choices


def infer_seqlen(source: Column, target: Column, cutoff: Column | int) -> tuple[Column, Column]:
    """How many source and target tokens fit into cutoff: a short side stays whole, two long ones share in proportion."""
    cutoff = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    share = (cutoff * target.cast("double") / F.greatest(source + target, F.lit(1))).cast("int")
    most_target = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise(share)
    new_target = F.least(most_target, target)
    return F.least(F.greatest(cutoff - new_target, F.lit(0)), source), new_target


def multiple_choice(question: Column, choices: dict[str, Column], answer_word: str = "Answer:") -> Column:
    """A question with its present choices by letter and a call for the answer."""
    shown = [F.coalesce(F.concat(F.lit(f"\n{k}. "), v), F.lit("")) for k, v in choices.items()]
    return F.concat(question, *shown, F.lit(f"\n{answer_word}"))


def best_choice(chances: Column) -> Column:
    """The letter of the greatest of the chances."""
    return F.chr(64 + F.array_position(chances, F.array_max(chances)))


def duration(seconds: Column) -> Column:
    """H:MM:SS; hours without leading zeros, days in front as words."""
    whole = F.floor(seconds).cast("long")
    days = F.floor(whole / 86400)
    clock = F.format_string("%d:%02d:%02d", F.floor(whole % 86400 / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.when(days > 0, F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "), clock)).otherwise(clock)


# ---- media and requests

DATA_URI = r"^data:(image|video|audio)/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=]+$"


def is_data_uri(c: Column) -> Column:
    return c.rlike(DATA_URI)


def is_public_url(c: Column) -> Column:
    """http(s) and not a local, private, link-local or loopback host by its name or literal address."""
    host = F.lower(F.regexp_extract(c, r"^https?://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]+)", 1))
    inside = host.rlike(r"^(localhost|.*\.local|.*\.localhost|0\..*|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|\[::1?\]|\[f[cd].*|\[fe80.*)$")
    return (host != "") & ~inside


def is_safe_path(c: Column, folder: str) -> Column:
    """Whether a relative or absolute path stays inside the folder, without stepping up."""
    base = folder.rstrip("/") + "/"
    return ~c.rlike(r"(^|/)\.\.(/|$)") & (~c.startswith("/") | c.startswith(base))


def resolve_media(paths: Column, folder: str, present: Column) -> Column:
    """Paths under the media folder where such a file is in the array ``present``; empty lists become null."""
    full = F.transform(paths, lambda p: F.when(F.array_contains(present, F.concat(F.lit(folder.rstrip("/") + "/"), p)), F.concat(F.lit(folder.rstrip("/") + "/"), p)).otherwise(p))
    return F.when(F.size(paths) > 0, full)


def placeholder_counts_match(messages: Column, **media: Column) -> Column:
    """Whether ``<image>`` and the like stand in the messages as often as the media lists have items."""
    text = F.array_join(F.transform(messages, lambda m: m["content"]), "")
    ok = [F.regexp_count(text, F.lit(f"<{k}>")) == F.coalesce(F.when(F.size(v) >= 0, F.size(v)), F.lit(0)) for k, v in media.items()]
    return F.lit(True) if not ok else ok[0] if len(ok) == 1 else F.forall(F.array(*ok), lambda x: x)


def modalities_supported(tokens: dict[str, str | None], **media: Column) -> Column:
    """Whether every kind of media that is present has a token."""
    missing = [F.coalesce(F.size(v) > 0, F.lit(False)) for k, v in media.items() if tokens.get(k) is None]
    return F.lit(True) if not missing else ~F.exists(F.array(*missing), lambda x: x)
