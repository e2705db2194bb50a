"""Chat templates: slots compiled to column expressions, rendering, thoughts, token ids.

A template is data: for each role a list of slots, which are text with ``{{content}}`` or a special token. ``render_turns`` builds one
string for each message, ``render`` the whole conversation; ids come from an injected tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import tools

BOS, EOS = {"bos_token"}, {"eos_token"}
Slots = tuple
THOUGHT = ("<think>\n", "\n</think>\n\n")


@dataclass(frozen=True)
class Template:
    """Slots by role; ``kind`` is plain, fused (the system text goes into the first question) or reasoning."""

    user: Slots = ("{{content}}",)
    assistant: Slots = ("{{content}}", "EOS")
    system: Slots = ("{{content}}",)
    function: Slots | None = None
    observation: Slots | None = None
    prefix: Slots = ()
    tool_format: str = "default"
    default_system: str = ""
    stop_words: tuple[str, ...] = ()
    kind: str = "plain"
    efficient_eos: bool = False
    replace_eos: bool = False
    thought: tuple[str, str] = THOUGHT
    enable_thinking: bool | None = True
    tokens: dict[str, str] = field(default_factory=lambda: {"BOS": "<s>", "EOS": "</s>"}, hash=False)

    def slots(self, role: str) -> Slots:
        own = {"user": self.user, "assistant": self.assistant, "function": self.function or self.assistant, "observation": self.observation or self.user}
        if role not in own:
            raise ValueError(f"unexpected role {role}")
        return own[role]


IM = lambda role, tail="": f"<|im_start|>{role}\n{{{{content}}}}<|im_end|>\n{tail}"
_ASK = "<|im_start|>assistant\n"
# The texts of the templates, as the models were trained on them.
_CHATML = Template(user=(IM("user", _ASK),), assistant=("{{content}}<|im_end|>\n",), system=(IM("system"),), observation=(IM("tool", _ASK),), stop_words=("<|im_end|>", "<|im_start|>"), replace_eos=True)
_QWEN = replace(_CHATML, observation=("<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n" + _ASK,), tool_format="qwen", stop_words=("<|im_end|>",))
_HEADER = lambda role: f"<|start_header_id|>{role}<|end_header_id|>\n\n"
TEMPLATES: dict[str, Template] = {
    "alpaca": Template(user=("### Instruction:\n{{content}}\n\n### Response:\n",), assistant=("{{content}}", "EOS", "\n\n"), default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"),
    "aquila": Template(user=("Human: {{content}}###Assistant:",), assistant=("{{content}}###",), system=("System: {{content}}###",), stop_words=("</s>",)),
    "chatml": _CHATML,
    "default": Template(user=("Human: {{content}}", "EOS", "\nAssistant:"), assistant=("{{content}}", "EOS", "\n"), system=("System: {{content}}", "EOS", "\n")),
    "deepseek3": Template(user=("<｜User｜>{{content}}<｜Assistant｜>",), prefix=("BOS",)),
    "deepseekr1": Template(user=("<｜User｜>{{content}}<｜Assistant｜>",), prefix=("BOS",), kind="reasoning"),
    "gemma": Template(
        user=("<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n",), assistant=("{{content}}<end_of_turn>\n",), system=("{{content}}\n\n",),
        observation=("<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n",), prefix=("BOS",), stop_words=("<end_of_turn>",), replace_eos=True, kind="fused",
    ),
    "glm4": Template(user=("<|user|>\n{{content}}<|assistant|>",), assistant=("\n{{content}}",), system=("<|system|>\n{{content}}",), function=("{{content}}",), observation=("<|observation|>\n{{content}}<|assistant|>",), prefix=("[gMASK]<sop>",), tool_format="glm4", stop_words=("<|user|>", "<|observation|>"), efficient_eos=True),
    "llama2": Template(user=("BOS", "[INST] {{content}} [/INST]"), system=("<<SYS>>\n{{content}}\n<</SYS>>\n\n",), kind="fused"),
    "llama3": Template(
        user=(_HEADER("user") + "{{content}}<|eot_id|>" + _HEADER("assistant"),), assistant=("{{content}}<|eot_id|>",), system=(_HEADER("system") + "{{content}}<|eot_id|>",),
        observation=(_HEADER("ipython") + "{{content}}<|eot_id|>" + _HEADER("assistant"),), prefix=("BOS",), tool_format="llama3", stop_words=("<|eot_id|>", "<|eom_id|>"), replace_eos=True,
    ),
    "mistral": Template(user=("[INST] {{content}}[/INST]",), assistant=(" {{content}}", "EOS"), system=("{{content}}\n\n",), function=("[TOOL_CALLS] {{content}}", "EOS"), observation=('[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]',), prefix=("BOS",), tool_format="mistral", kind="fused"),
    "phi": Template(user=("<|user|>\n{{content}}<|end|>\n<|assistant|>\n",), assistant=("{{content}}<|end|>\n",), system=("<|system|>\n{{content}}<|end|>\n",), stop_words=("<|end|>",), replace_eos=True),
    "qwen": replace(_QWEN, default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant."),
    "qwen3": replace(_QWEN, kind="reasoning"),
}


def register_template(name: str, template: Template) -> None:
    if name in TEMPLATES:
        raise ValueError(f"template {name} exists")
    TEMPLATES[name] = template


def get_template(name: str | None, tool_format: str | None = None, default_system: str | None = None, enable_thinking: bool | None = True, train_on_prompt: bool = False) -> Template:
    """By name, with the overrides of the data options; without a name the empty template."""
    if name is not None and name not in TEMPLATES:
        raise ValueError(f"unknown template {name}")
    out = replace(TEMPLATES[name] if name else Template(), enable_thinking=enable_thinking)
    if train_on_prompt and out.efficient_eos:
        raise ValueError("this template cannot be trained on prompts")
    if tool_format is not None:
        tools.tool_format(tool_format)
        out = replace(out, tool_format=tool_format)
    return replace(out, default_system=default_system) if default_system is not None else out


def fill(t: Template, slots: Slots, **values: Column) -> Column:
    """Slots as one column; each placeholder is replaced once in a slot, and special tokens by their text."""
    parts: list[Column] = []
    for slot in slots:
        if slot in t.tokens:
            parts.append(F.lit(t.tokens[slot]))
            continue
        rest, left = slot, dict(values)
        while left:
            at, name = min(((rest.find("{{" + k + "}}"), k) for k in left if "{{" + k + "}}" in rest), default=(-1, ""))
            if at < 0:
                break
            parts += [F.lit(rest[:at]), left.pop(name)]
            rest = rest[at + len(name) + 4 :]
        parts.append(F.lit(rest))
    return F.concat(*parts) if parts else F.lit("")


def remove_thought(c: Column, t: Template) -> Column:
    start, end = (re.escape(x) for x in t.thought)
    return F.regexp_replace(F.regexp_replace(c, f"(?s){start}(.*?){end}", ""), r"^\n+", "")


def has_thought(c: Column, t: Template) -> Column:
    return F.contains(c, F.lit(t.thought[0].strip())) | F.contains(c, F.lit(t.thought[1].strip()))


def render_turns(messages: Column, t: Template, system: Column | str = "", tool_text: Column | str = "") -> Column:
    """One string for each message (role, content). The first has the prefix and the system text with the tools."""
    system, tool_text = (F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in (system, tool_text))
    shown = F.concat(F.when(system == "", F.lit(t.default_system)).otherwise(system), tool_text)
    opening = F.when(shown != "", fill(t, t.system, content=shown)).otherwise("")
    prefix = fill(t, t.prefix)

    def one(m: Column, i: Column) -> Column:
        content = F.concat(F.when(i == 0, opening).otherwise(""), m["content"]) if t.kind == "fused" else m["content"]
        out = F.raise_error(F.concat(F.lit("unexpected role "), m["role"])).cast("string")
        for role in ("user", "assistant", "observation", "function"):
            said = content if role == "user" else m["content"]
            out = F.when(m["role"] == role, fill(t, t.slots(role), content=said, idx=F.floor(i / 2).cast("string"))).otherwise(out)
        before = prefix if t.kind == "fused" else F.concat(prefix, opening)
        return F.concat(F.when(i == 0, before).otherwise(""), out)

    return F.transform(messages, one)


def think(messages: Column, t: Template, one_turn: bool) -> Column:
    """Messages as the reasoning template wants them: thoughts of earlier replies (or, with thinking off, of all) removed."""
    if t.kind != "reasoning":
        return messages
    n = F.size(messages)

    def one(m: Column, i: Column) -> Column:
        off = F.lit(t.enable_thinking is False)
        drop = (i % 2 == 1) & (off | ((i < n - 2) if one_turn else F.lit(False)))
        return F.struct(m["role"].alias("role"), F.when(drop, remove_thought(m["content"], t)).otherwise(m["content"]).alias("content"))

    return F.transform(messages, one)


def turn_pairs(messages: Column, t: Template, system: Column | str = "", tool_text: Column | str = "") -> Column:
    """Array of (source, target) strings, one for each question and reply; empty thoughts are put in where they are due."""
    kept = think(messages, t, one_turn=False)
    turns = render_turns(kept, t, system, tool_text)
    empty = F.lit("".join(t.thought))

    def pair(k: Column) -> Column:
        source, target = F.get(turns, k * 2), F.get(turns, k * 2 + 1)
        if t.kind == "reasoning":
            bare = ~has_thought(F.get(kept, k * 2 + 1)["content"], t)
            if t.enable_thinking:
                target = F.when(bare, F.concat(empty, target)).otherwise(target)
            else:
                source = F.when(bare, F.concat(source, empty)).otherwise(source)
        return F.struct(source.alias("source"), target.alias("target"))

    return F.when(F.size(messages) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(messages) / 2).cast("int") - 1), pair)).otherwise(F.array().cast("array<struct<source: string, target: string>>"))


def one_turn(messages: Column, t: Template, system: Column | str = "", tool_text: Column | str = "") -> Column:
    """(prompt, response) strings: all but the last message, and the last."""
    kept = think(messages, t, one_turn=True)
    turns = render_turns(kept, t, system, tool_text)
    n = F.size(messages)
    prompt, response = F.array_join(F.slice(turns, F.lit(1), F.greatest(n - 1, F.lit(0))), ""), F.get(turns, n - 1)
    if t.kind == "reasoning":
        bare, empty = ~has_thought(F.get(kept, n - 1)["content"], t), F.lit("".join(t.thought))
        if t.enable_thinking:
            response = F.when(bare, F.concat(empty, response)).otherwise(response)
        else:
            prompt = F.when(bare, F.concat(prompt, empty)).otherwise(prompt)
    return F.struct(prompt.alias("prompt"), response.alias("response"))


def render(messages: Column, t: Template, system: Column | str = "", tool_text: Column | str = "") -> Column:
    return F.array_join(render_turns(think(messages, t, one_turn=False), t, system, tool_text), "")


def byte_ids(texts: list[str]) -> list[list[int]]:
    """A tokenizer for tests: UTF-8 bytes."""
    return [list(x.encode()) for x in texts]


def ids_column(c: Column, encode: Callable[[list[str]], list[list[int]]] = byte_ids) -> Column:
    """Token ids of a text column by an injected batch encoder."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.fillna("").tolist()), index=texts.index)

    return run(c)


def pairs_ids(rows: DataFrame, pairs: str, encode: Callable[[list[str]], list[list[int]]] = byte_ids) -> DataFrame:
    """The rows with ``pairs`` (source, target strings) as arrays of ids."""
    kind = ArrayType(ArrayType(ArrayType(IntegerType())))

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        flat = [x for p in column for turn in p for x in (turn[0], turn[1])]
        ids = iter(encode(flat))
        return pd.Series([[[next(ids), next(ids)] for _ in p] for p in column], index=column.index)

    as_lists = F.transform(pairs, lambda p: F.array(p["source"], p["target"]))
    return rows.withColumn(pairs, F.transform(run(as_lists), lambda x: F.struct(x[0].alias("source"), x[1].alias("target"))))


def stop_token_ids(t: Template, encode: Callable[[list[str]], list[list[int]]], eos_id: int) -> list[int]:
    return sorted({eos_id, *(i for ids in encode(list(t.stop_words)) for i in ids[-1:])})


def special_tokens(t: Template, eos: str | None = None) -> dict[str, str | list[str]]:
    """What a tokenizer must know: the end, from the first stop word where the template replaces it, and further stop words."""
    words = list(t.stop_words)
    end = words.pop(0) if t.replace_eos and words else eos or t.tokens["EOS"]
    return {"eos_token": end, "pad_token": end, "additional_special_tokens": words}


def _quoted(t: Template, slots: Slots, name: str) -> str:
    """Slots as a Jinja expression."""
    parts = []
    for slot in slots:
        if slot in t.tokens:
            parts.append(f"'{t.tokens[slot]}'")
        else:
            for k, piece in enumerate(slot.split("{{content}}")):
                parts += [name] * (k > 0) + ["'" + piece.replace("'", r"\'").replace("\n", r"\n") + "'"] * bool(piece)
    return " + ".join(parts)


def jinja(t: Template) -> str:
    """A Jinja chat template of plain and fused templates."""
    lead = f"{{{{ {_quoted(t, t.prefix, '')} }}}}" if t.prefix else ""
    default = f"{{% set system_message = '{t.default_system}' %}}" if t.default_system else ""
    pick = "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}{% else %}{% set loop_messages = messages %}{% endif %}"
    system = _quoted(t, t.system, "system_message")
    first = "" if t.kind == "fused" else f"{{% if system_message is defined %}}{{{{ {system} }}}}{{% endif %}}"
    content = f"{{% if loop.index0 == 0 and system_message is defined %}}{{% set content = {system} + message['content'] %}}{{% else %}}{{% set content = message['content'] %}}{{% endif %}}" if t.kind == "fused" else "{% set content = message['content'] %}"
    said = f"{{% if message['role'] == 'user' %}}{{{{ {_quoted(t, t.user, 'content')} }}}}{{% elif message['role'] == 'assistant' %}}{{{{ {_quoted(t, t.assistant, 'content')} }}}}{{% endif %}}"
    return f"{lead}{default}{pick}{first}{{% for message in loop_messages %}}{content}{said}{{% endfor %}}"


def modelfile(t: Template, model: str = ".", context: int = 4096) -> str:
    """A model file with the template in Go's syntax and its stop words."""

    def go(slots: Slots, name: str) -> str:
        return "".join(t.tokens[s] if s in t.tokens else s.replace("{{content}}", f"{{{{ {name} }}}}") for s in slots)

    body = go(t.prefix, "") + "{{ if .System }}" + go(t.system, ".System") + "{{ end }}" + '{{ range .Messages }}{{ if eq .Role "user" }}' + go(t.user, ".Content") + '{{ else if eq .Role "assistant" }}' + go(t.assistant, ".Content") + "{{ end }}{{ end }}"
    lines = [f"FROM {model}", "", f'TEMPLATE """{body}"""', ""]
    lines += [f'SYSTEM """{t.default_system}"""', ""] if t.default_system else []
    return "\n".join([*lines, *(f'PARAMETER stop "{w}"' for w in t.stop_words), f"PARAMETER num_ctx {context}"])


# ---- media placeholders


@dataclass(frozen=True)
class MediaTokens:
    """How a placeholder is written out: tokens before, for each unit, and after."""

    image: tuple[str, str, str] | None = None
    video: tuple[str, str, str] | None = None
    audio: tuple[str, str, str] | None = None


# Marks of the model families; how many units an item has comes from the caller.
MEDIA: dict[str, MediaTokens] = {
    "base": MediaTokens(),
    "gemma3": MediaTokens(image=("\n\n<start_of_image>", "<image_soft_token>", "<end_of_image>\n\n")),
    "intern_vl": MediaTokens(image=("<img>", "<IMG_CONTEXT>", "</img>"), video=("<img>", "<IMG_CONTEXT>", "</img>")),
    "kimi_vl": MediaTokens(image=("<|media_start|>image<|media_content|>", "<|media_pad|>", "<|media_end|>")),
    "llava": MediaTokens(image=("", "<image>", "")),
    "llava_next": MediaTokens(image=("", "<image>", "")),
    "llava_next_video": MediaTokens(image=("", "<image>", ""), video=("", "<video>", "")),
    "minicpm_v": MediaTokens(image=("<image>", "<unk>", "</image>"), audio=("<audio>", "<unk>", "</audio>")),
    "paligemma": MediaTokens(image=("", "", "")),
    "pixtral": MediaTokens(image=("", "[IMG]", "[IMG_END]")),
    "qwen2_audio": MediaTokens(audio=("<|audio_bos|>", "<|AUDIO|>", "<|audio_eos|>")),
    "qwen2_vl": MediaTokens(image=("<|vision_start|>", "<|image_pad|>", "<|vision_end|>"), video=("<|vision_start|>", "<|video_pad|>", "<|vision_end|>")),
    "qwen2_omni": MediaTokens(image=("<|vision_bos|>", "<|IMAGE|>", "<|vision_eos|>"), video=("<|vision_bos|>", "<|VIDEO|>", "<|vision_eos|>"), audio=("<|audio_bos|>", "<|AUDIO|>", "<|audio_eos|>")),
    "video_llava": MediaTokens(image=("", "<image>", ""), video=("", "<video>", "")),
}


def expand_media(messages: Column, plugin: str, **counts: Column) -> Column:
    """Messages with each placeholder written out; ``counts`` has the units of each item by kind, in order over all messages."""
    spec = MEDIA[plugin]
    for kind, units in counts.items():
        marks = getattr(spec, kind)
        if marks is None:
            continue
        before, unit, after = marks

        def step(acc: Column, m: Column) -> Column:  # called at once, within this turn of the loop
            parts = F.split(m["content"], f"<{kind}>")
            used = acc["used"]
            text = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(before), F.repeat(F.lit(unit), F.coalesce(F.get(units, used + i - 1), F.lit(1))), F.lit(after), p))), "")
            said = F.array(F.struct(m["role"].alias("role"), text.alias("content")))
            return F.struct(F.concat(acc["out"], said).alias("out"), (used + F.size(parts) - 1).alias("used"))

        start = F.struct(F.array().cast("array<struct<role: string, content: string>>").alias("out"), F.lit(0).alias("used"))
        messages = F.aggregate(messages, start, step)["out"]
    return messages


def prepend_image_ids(ids: Column, labels: Column, image_id: int, count: Column) -> tuple[Column, Column]:
    """Ids and labels with image tokens in front, which are not trained."""
    return F.concat(F.array_repeat(F.lit(image_id), count), ids), F.concat(F.array_repeat(F.lit(-100), count), labels)


def token_types(ids: Column, image_id: int | None = None, image_count: Column | None = None) -> Column:
    """1 at image ids, or 0 for the leading image tokens and 1 for the rest."""
    if image_id is not None:
        return F.transform(ids, lambda x: F.when(x == image_id, 1).otherwise(0))
    return F.transform(ids, lambda x, i: F.when(i < image_count, 0).otherwise(1))


def fit_image(width: Column, height: Column, most: int, least: int) -> tuple[Column, Column]:
    """Width and height scaled by one factor so that the pixels lie between least and most."""
    pixels = width.cast("double") * height
    factor = F.when(pixels > most, F.sqrt(most / pixels)).when(pixels < least, F.sqrt(least / pixels)).otherwise(1.0)
    return (width * factor).cast("int"), (height * factor).cast("int")


def frame_indices(frames: Column, seconds: Column, fps: float, most: int) -> Column:
    """Evenly spaced frame numbers: seconds times fps of them, at least one, at most the frames there are and ``most``."""
    n = F.greatest(F.least(F.floor(seconds * fps).cast("int"), frames, F.lit(most)), F.lit(1))
    n = F.when(frames == 0, F.greatest(F.least(F.floor(seconds * fps).cast("int"), F.lit(most)), F.lit(1))).otherwise(n)
    return F.when(n == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * (frames - 1) / (n - 1)).cast("int")))


def audio_length(samples: Column, hop: int = 160) -> Column:
    """Tokens of an audio: feature frames halved twice by convolutions."""
    frames = F.floor(samples / hop)
    first = F.floor((frames - 1) / 2) + 1
    return (F.floor((first - 2) / 2) + 1).cast("int")
