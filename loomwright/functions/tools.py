"""Tool descriptions, calls and their extraction in the formats of several model families.

A format is three functions on plain Python values; ``tool_column``, ``call_column`` and ``extract_column`` wrap them as
pandas functions, as the exact JSON text (blanks after separators, indentation, key order) cannot be had from ``to_json``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Call = tuple[str, str]  # name, arguments as JSON text

# Prompts and marks that the model families expect.
DEFAULT_PROMPT = "You have access to the following tools:\n{tools}Use the following format if using a tool:\n```\nAction: tool name (one of [{names}])\nAction Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{{\"input\": \"hello world\", \"num_beams\": 5}}```)\n```\n"
GLM4_PROMPT = "你是一个名为 ChatGLM 的人工智能助手。你是基于智谱 AI 公司训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n# 可用工具{tools}"
GLM4_TOOL = "\n\n## {name}\n\n{body}\n在调用上述函数时，请使用 Json 格式表示调用的参数。"
SIGNATURES = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>{tools}\n</tools>\n\nFor each function call, "
JSON_CALLS = 'return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{{"name": <function-name>, "arguments": <args-json-object>}}\n</tool_call>'
XML_CALLS = "output the function name and arguments within the following XML format:\n<tool_call>{{function-name}}\n<arg_key>{{arg-key-1}}</arg_key>\n<arg_value>{{arg-value-1}}</arg_value>\n<arg_key>{{arg-key-2}}</arg_key>\n<arg_value>{{arg-value-2}}</arg_value>\n...\n</tool_call>\n"
LLAMA3_PROMPT = 'Cutting Knowledge Date: December 2023\nToday Date: {date}\n\nYou have access to the following functions. To call a function, please respond with JSON for a function call. Respond in the format {{"name": function name, "parameters": dictionary of argument name and its value}}. Do not use variables.\n\n{tools}'
SEED_PROMPT = "system\nYou are Doubao, a helpful AI assistant. You may call one or more functions to assist with the user query.Tool List:\nYou are authorized to use the following tools (described in JSON Schema format). Before performing any task, you must decide how to call them based on the descriptions and parameters of these tools.{tools}\n工具调用请遵循如下格式:\n<seed:tool_call>\n<function=example_function_name>\n<parameter=example_parameter_1>value_1</parameter>\n<parameter=example_parameter_2>This is the value for the second parameter\nthat can span\nmultiple lines</parameter>\n</function>\n</seed:tool_call>\n"


def dump(x, **how) -> str:
    return json.dumps(x, ensure_ascii=False, **how)


def bare(tool: dict) -> dict:
    return tool.get("function", {}) if tool.get("type") == "function" else tool


def wrapped(tool: dict) -> dict:
    return tool if tool.get("type") == "function" else {"type": "function", "function": tool}


def lines_of(tools: list[dict]) -> str:
    return "".join("\n" + dump(wrapped(t)) for t in tools)


def described(tools: list[dict]) -> str:
    """A list in words: name, description and one line for each argument."""
    text = ""
    for tool in map(bare, tools):
        spec = tool["parameters"]
        args = ""
        for name, p in spec["properties"].items():
            notes = f", should be one of [{', '.join(p['enum'])}]" if p.get("enum") else ""
            notes += f", where each item should be {p['items'].get('type', '')}" if p.get("items") else ""
            need = ", required" if name in spec.get("required", []) else ""
            args += f"  - {name} ({p.get('type', '')}{need}): {p.get('description', '')}{notes}\n"
        text += f"> Tool Name: {tool['name']}\nTool Description: {tool.get('description', '')}\nTool Args:\n{args}\n"
    return DEFAULT_PROMPT.format(tools=text, names=", ".join(bare(t)["name"] for t in tools))


def parsed(text: str):
    """The JSON value of a text, or None where it is none."""
    try:
        return json.loads(text)
    except ValueError:
        return None


def from_objects(key: str) -> Callable[[str], str | list[Call]]:
    """Reads one object or a list of objects with a name and arguments under ``key``."""

    def read(text: str):
        value = parsed(text.strip())
        items = value if isinstance(value, list) else [value]
        if value is None or not all(isinstance(i, dict) and "name" in i and key in i for i in items):
            return text
        return [(i["name"], dump(i[key])) for i in items]

    return read


def read_actions(text: str):
    found = re.findall(r"Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)", text, re.DOTALL)
    values = [parsed(raw.strip().strip('"').strip("```")) for _, raw in found]
    return [(name, dump(v)) for (name, _), v in zip(found, values, strict=True)] if found and None not in values else text


def read_name_line(text: str):
    name, line_feed, rest = text.partition("\n")
    value = parsed(rest.strip()) if line_feed else None
    return text if value is None else [(name, dump(value))]


def read_marked(text: str):
    found = [parsed(x.strip()) for x in re.findall(r"<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)", text, re.DOTALL)]
    if not found or not all(isinstance(x, dict) and {"name", "arguments"} <= x.keys() for x in found):
        return text
    return [(x["name"], dump(x["arguments"])) for x in found]


def read_seed(text: str):
    out = []
    for name, block in re.findall(r"<seed:tool_call>\s*<function=\s*([^\s<]+)\s*(.*?)\s*</function>\s*</seed:tool_call>", text, re.DOTALL):
        args = {}
        for key, raw in re.findall(r"<parameter=(.*?)>(.*?)</parameter>", block.strip(), re.DOTALL):
            value = parsed(raw.strip())
            args[key] = raw if value is None and raw.strip() != "null" else value
        out.append((name, dump(args)))
    return out  # without a call an empty list, unlike the others


def one_name_line(calls: list[Call]) -> str:
    if len(calls) > 1:
        raise ValueError("this format has no parallel calls")
    return "\n".join(calls[0])


def objects(key: str, always_list: bool) -> Callable[[list[Call]], str]:
    def write(calls: list[Call]) -> str:
        items = [{"name": n, key: json.loads(a)} for n, a in calls]
        return dump(items if always_list or len(items) != 1 else items[0])

    return write


def tagged(start: str, key: str, value: str, end: str) -> Callable[[list[Call]], str]:
    """Each argument as text between marks; other values than texts as JSON."""

    def write(calls: list[Call]) -> str:
        shown = lambda v: v if isinstance(v, str) else dump(v)
        return "\n".join(start.replace("%", n) + "".join(key.replace("%", k) + value.replace("%", shown(v)) for k, v in json.loads(a).items()) + end for n, a in calls)

    return write


def marked(calls: list[Call]) -> str:
    return "\n".join(f"<tool_call>\n{dump({'name': n, 'arguments': json.loads(a)})}\n</tool_call>" for n, a in calls)


@dataclass(frozen=True)
class ToolFormat:
    tools: Callable[[list[dict]], str]
    calls: Callable[[list[Call]], str]
    extract: Callable[[str], str | list[Call]]


FORMATS: dict[str, ToolFormat] = {
    "default": ToolFormat(described, lambda calls: "\n".join(f"Action: {n}\nAction Input: {a}" for n, a in calls), read_actions),
    "glm4": ToolFormat(lambda t: GLM4_PROMPT.format(tools="".join(GLM4_TOOL.format(name=bare(x)["name"], body=dump(bare(x), indent=4)) for x in t)), one_name_line, read_name_line),
    "llama3": ToolFormat(lambda t: LLAMA3_PROMPT.format(date=datetime.now().strftime("%d %b %Y"), tools="".join(dump(wrapped(x), indent=4) + "\n\n" for x in t)), objects("parameters", False), from_objects("parameters")),
    "mistral": ToolFormat(lambda t: f"[AVAILABLE_TOOLS] {dump([wrapped(x) for x in t])}[/AVAILABLE_TOOLS]", objects("arguments", True), from_objects("arguments")),
    "qwen": ToolFormat(lambda t: ("\n\n" + SIGNATURES + JSON_CALLS).format(tools=lines_of(t)), marked, read_marked),
    "glm4_moe": ToolFormat(lambda t: ("\n\n" + SIGNATURES + XML_CALLS).format(tools=lines_of(t)), tagged("\n<tool_call>%", "\n<arg_key>%</arg_key>", "\n<arg_value>%</arg_value>", ""), read_marked),
    "seed_oss": ToolFormat(lambda t: SEED_PROMPT.format(tools="\n" + dump(t)), tagged("\n<seed:tool_call>\n<function=%", "\n<parameter=%>", "%</parameter>", "\n</function>\n</seed:tool_call>"), read_seed),
    "ling": ToolFormat(lambda t: (SIGNATURES + JSON_CALLS).format(tools=lines_of(t)) + "\ndetailed thinking off", marked, read_marked),
}


def tool_format(name: str) -> ToolFormat:
    if name not in FORMATS:
        raise ValueError(f"unknown tool format {name}; known are {', '.join(FORMATS)}")
    return FORMATS[name]


def register_tool_format(name: str, form: ToolFormat) -> None:
    if name in FORMATS:
        raise ValueError(f"tool format {name} exists")
    FORMATS[name] = form


def render_calls(content: str, form: ToolFormat, thought: tuple[str, str] = ("<think>\n", "\n</think>\n\n")) -> str:
    """JSON of one call or a list, after an optional thought, as the format writes them; the thought stays in front."""
    found = re.search(re.escape(thought[0]) + "(.*?)" + re.escape(thought[1]), content, re.DOTALL)
    before, rest = (found.group(0), content.replace(found.group(0), "")) if found else ("", content)
    value = json.loads(rest)
    items = value if isinstance(value, list) else [value]
    return before + form.calls([(i["name"], dump(i["arguments"])) for i in items])


def _column(work: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else work(t))

    return run


def tool_column(tools: Column, name: str) -> Column:
    """The description of tools given as JSON text; empty for no tools."""
    form = tool_format(name)
    return _column(lambda t: form.tools(json.loads(t)) if t and json.loads(t) else "")(tools)


def call_column(content: Column, name: str) -> Column:
    form = tool_format(name)
    return _column(lambda t: render_calls(t, form))(content)


def extract_column(content: Column, name: str) -> Column:
    """Calls found in a text as JSON [[name, arguments], ...]; null where the text is plain."""
    form = tool_format(name)
    return _column(lambda t: None if isinstance(got := form.extract(t), str) else dump(got))(content)
