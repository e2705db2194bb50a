"""Rows of several conversation formats aligned to one schema: _prompt, _response, _system, _tools, media lists.

All as column expressions. Rows that break the rules of their format get an empty prompt and response, which the filters of the
encoders drop. Where ``columns`` of a dataset are given, those not listed are null, not their default.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MESSAGES

USER, ASSISTANT, OBSERVATION, FUNCTION = "user", "assistant", "observation", "function"
QUESTIONS, REPLIES = (USER, OBSERVATION), (ASSISTANT, FUNCTION)
JOINT = "\n</tool_response>\n<tool_response>\n"
THINKING_OFF = "detailed thinking off"


@dataclass(frozen=True)
class DatasetAttr:
    """How a dataset is read: format, column names and tags."""

    load_from: str = "file"
    dataset_name: str = ""
    formatting: str = "alpaca"
    ranking: bool = False
    subset: str | None = None
    split: str = "train"
    folder: str | None = None
    num_samples: int | None = None
    system: str | None = None
    tools: str | None = None
    images: str | None = None
    videos: str | None = None
    audios: str | None = None
    chosen: str | None = None
    rejected: str | None = None
    kto_tag: str | None = None
    prompt: str | None = "instruction"
    query: str | None = "input"
    response: str | None = "output"
    history: str | None = None
    messages: str | None = "conversations"
    role_tag: str | None = "from"
    content_tag: str | None = "value"
    user_tag: str | None = "human"
    assistant_tag: str | None = "gpt"
    observation_tag: str | None = "observation"
    function_tag: str | None = "function_call"
    system_tag: str | None = "system"


COLUMNS = ("system", "tools", "images", "videos", "audios", "chosen", "rejected", "kto_tag", "prompt", "query", "response", "history", "messages")
TAGS = ("role_tag", "content_tag", "user_tag", "assistant_tag", "observation_tag", "function_tag", "system_tag")


def dataset_attr(entry: dict, **base) -> DatasetAttr:
    """From a registry entry: given columns or tags replace all of their kind."""
    known = {f.name for f in fields(DatasetAttr)}
    values = {k: v for k, v in {**base, **entry}.items() if k in known}
    for part, names in (("columns", COLUMNS), ("tags", TAGS)):
        if part in entry:
            values.update({n: entry[part].get(n) for n in names})
    return DatasetAttr(**values)


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def no_messages() -> Column:
    return F.array().cast(MESSAGES)


def text_of(rows: DataFrame, name: str | None) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name and name in rows.columns else F.lit("")


def media_of(rows: DataFrame, name: str | None) -> Column:
    """A list of media; one text becomes a list of one, an empty list null."""
    if not name or name not in rows.columns:
        return F.lit(None).cast("array<string>")
    if not rows.schema[name].dataType.typeName() == "array":
        return F.when(F.col(name).isNotNull(), F.array(F.col(name).cast("string")))
    return F.when(F.size(name) > 0, F.col(name).cast("array<string>"))


def alternates(messages: Column) -> Column:
    """Whether questions stand at even places and replies at odd ones."""
    return F.forall(F.transform(messages, lambda m, i: F.when(i % 2 == 0, m["role"].isin(*QUESTIONS)).otherwise(m["role"].isin(*REPLIES))), lambda ok: F.coalesce(ok, F.lit(False)))


def is_bool(rows: DataFrame, name: str | None) -> bool:
    return bool(name) and name in rows.columns and rows.schema[name].dataType.typeName() == "boolean"


def kto_pair(tag: Column, reply: Column) -> Column:
    """The reply first where the tag is true, else behind an empty one; null for a null tag."""
    empty = F.array(message(ASSISTANT, F.lit("")))
    return F.when(tag, F.concat(reply, empty)).when(~tag, F.concat(empty, reply))


def aligned(rows: DataFrame, attr: DatasetAttr, prompt: Column, response: Column, system: Column, tools: Column) -> DataFrame:
    media = [media_of(rows, n).alias(f"_{k}") for k, n in (("images", attr.images), ("videos", attr.videos), ("audios", attr.audios))]
    return rows.select(prompt.alias("_prompt"), response.alias("_response"), system.alias("_system"), tools.alias("_tools"), *media)


def align_alpaca(rows: DataFrame, attr: DatasetAttr) -> DataFrame:
    prompt = no_messages()
    if attr.history and attr.history in rows.columns:
        old = F.coalesce(F.col(attr.history), F.array().cast("array<array<string>>"))
        prompt = F.flatten(F.transform(old, lambda h: F.array(message(USER, h[0]), message(ASSISTANT, h[1]))))
    asked = [F.nullif(text_of(rows, n), F.lit("")) for n in (attr.prompt, attr.query)]
    prompt = F.concat(prompt, F.array(message(USER, F.concat_ws("\n", *asked))))
    reply = F.array(message(ASSISTANT, F.col(attr.response))) if attr.response and attr.response in rows.columns else None
    response = no_messages() if reply is None else F.when(F.col(attr.response).isNotNull(), reply).otherwise(no_messages())
    if attr.ranking and attr.chosen in rows.columns and attr.rejected in rows.columns:
        pair = F.array(message(ASSISTANT, F.col(attr.chosen)), message(ASSISTANT, F.col(attr.rejected)))
        response = F.when(F.col(attr.chosen).isNotNull() & F.col(attr.rejected).isNotNull(), pair).otherwise(response)
    if is_bool(rows, attr.kto_tag) and reply is not None:
        response = F.coalesce(kto_pair(F.col(attr.kto_tag), reply), response)
    return aligned(rows, attr, prompt, response, text_of(rows, attr.system), text_of(rows, attr.tools))


def role_map(attr: DatasetAttr) -> dict[str, str]:
    tags = ((attr.user_tag, USER), (attr.assistant_tag, ASSISTANT), (attr.observation_tag, OBSERVATION), (attr.function_tag, FUNCTION), (attr.system_tag, "system"))
    return {t: r for t, r in tags if t}


def mapped(role: Column, roles: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for t, r in roles.items():
        out = F.when(role == t, r).otherwise(out)
    return out


def split_system(rows: DataFrame, attr: DatasetAttr) -> tuple[Column, Column]:
    """The messages without a leading system one, and the system text."""
    every = F.coalesce(F.col(attr.messages), F.array().cast(rows.schema[attr.messages].dataType))
    leads = F.coalesce(F.get(every, F.lit(0))[attr.role_tag] == attr.system_tag, F.lit(False)) if attr.system_tag else F.lit(False)
    rest = F.when(leads, F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0)))).otherwise(every)
    return rest, F.when(leads, F.get(every, F.lit(0))[attr.content_tag]).otherwise(text_of(rows, attr.system))


def replies(rows: DataFrame, attr: DatasetAttr, chat: Column, sound: Column) -> tuple[Column, Column]:
    """Prompt and response of whole conversations by the kind of dataset; empty where they are not sound."""
    n = F.size(chat)
    sound = sound & (n % 2 == (1 if attr.ranking else 0)) & ((n > 0) | F.lit(attr.ranking))
    last, before = F.slice(chat, F.greatest(n, F.lit(1)), F.lit(1)), F.slice(chat, F.lit(1), F.greatest(n - 1, F.lit(0)))
    prompt, response = before, last
    if attr.ranking and attr.chosen and attr.rejected:
        roles = role_map(attr)
        pair = [message(mapped(F.col(c)[attr.role_tag], roles), F.col(c)[attr.content_tag]) for c in (attr.chosen, attr.rejected)]
        both = F.col(attr.chosen).isNotNull() & F.col(attr.rejected).isNotNull()
        sound = sound & F.when(both, F.coalesce(pair[0]["role"].isin(*REPLIES) & pair[1]["role"].isin(*REPLIES), F.lit(False))).otherwise(True)
        prompt, response = F.when(both, chat).otherwise(before), F.when(both, F.array(*pair)).otherwise(last)
    if is_bool(rows, attr.kto_tag):
        tag = F.col(attr.kto_tag)
        response = F.when(tag.isNotNull(), kto_pair(tag, last)).otherwise(response)
        prompt = F.when(tag.isNotNull(), before).otherwise(prompt)
    return F.when(sound, prompt).otherwise(no_messages()), F.when(sound, response).otherwise(no_messages())


def align_sharegpt(rows: DataFrame, attr: DatasetAttr) -> DataFrame:
    rest, system = split_system(rows, attr)
    roles = role_map(attr)
    chat = F.transform(rest, lambda m: message(mapped(m[attr.role_tag], roles), m[attr.content_tag]))
    rows = rows.withColumn("_chat", chat)
    prompt, response = replies(rows, attr, F.col("_chat"), alternates(F.col("_chat")))
    return aligned(rows, attr, prompt, response, system, text_of(rows, attr.tools))


def merge_observations(messages: Column) -> Column:
    """Runs of observations joined to one message before the next other one; a run at the end is lost."""
    start = F.struct(no_messages().alias("out"), F.array().cast("array<string>").alias("held"))

    def step(acc: Column, m: Column) -> Column:
        said = F.array(message(m["role"], m["content"]))
        run = F.array(message(OBSERVATION, F.array_join(acc["held"], JOINT)))
        joined = F.when(F.size(acc["held"]) > 0, F.concat(acc["out"], run, said)).otherwise(F.concat(acc["out"], said))
        keep = F.struct(acc["out"].alias("out"), F.concat(acc["held"], F.array(m["content"])).alias("held"))
        return F.when(m["role"] == OBSERVATION, keep).otherwise(F.struct(joined.alias("out"), F.array().cast("array<string>").alias("held")))

    return F.aggregate(messages, start, step)["out"]


def openai_system(system: Column, tools: Column) -> Column:
    """With neither system nor tools the thinking is off; a system alone says so unless it says either; with tools it gets a line feed."""
    told = F.contains(system, F.lit("detailed thinking on")) | F.contains(system, F.lit(THINKING_OFF))
    alone = F.when(told, system).otherwise(F.concat(system, F.lit("\n" + THINKING_OFF)))
    return F.when(system == "", F.when(tools == "", THINKING_OFF).otherwise(system)).otherwise(F.when(tools == "", alone).otherwise(F.concat(system, F.lit("\n"))))


def align_openai(rows: DataFrame, attr: DatasetAttr) -> DataFrame:
    rest, system = split_system(rows, attr)
    roles = role_map(attr)
    has_calls = "tool_calls" in rows.schema[attr.messages].dataType.elementType.names

    def turn(m: Column) -> Column:
        role, content = mapped(m[attr.role_tag], roles), m[attr.content_tag]
        if has_calls:
            made = F.coalesce(role.isin(*REPLIES) & (F.size(m["tool_calls"]) > 0), F.lit(False))
            pieces = F.transform(m["tool_calls"], lambda c: F.concat(F.lit('{"name": '), F.to_json(F.array(c["function"]["name"])).substr(F.lit(2), F.length(F.to_json(F.array(c["function"]["name"]))) - 2), F.lit(', "arguments": '), F.to_json(F.array(c["function"]["arguments"])).substr(F.lit(2), F.length(F.to_json(F.array(c["function"]["arguments"]))) - 2), F.lit("}")))
            content = F.when(made, F.concat(F.lit("["), F.array_join(pieces, ", "), F.lit("]"))).otherwise(content)
            role = F.when(made, FUNCTION).otherwise(role)
        return message(role, content)

    rows = rows.withColumn("_chat", merge_observations(F.transform(rest, turn)))
    prompt, response = replies(rows, attr, F.col("_chat"), alternates(F.col("_chat")))
    tools = text_of(rows, attr.tools)
    return aligned(rows, attr, prompt, response, openai_system(F.coalesce(system, F.lit("")), tools), tools)


Converter = Callable[[DataFrame, DatasetAttr], DataFrame]
CONVERTERS: dict[str, Converter] = {"alpaca": align_alpaca, "sharegpt": align_sharegpt, "openai": align_openai}


def register_converter(name: str, converter: Converter) -> None:
    if name in CONVERTERS:
        raise ValueError(f"converter {name} exists")
    CONVERTERS[name] = converter


def align_dataset(rows: DataFrame, attr: DatasetAttr) -> DataFrame:
    if attr.formatting not in CONVERTERS:
        raise ValueError(f"unknown format {attr.formatting}; known are {', '.join(CONVERTERS)}")
    return CONVERTERS[attr.formatting](rows, attr)


# ---- filters on aligned rows


def valid_sft(rows: DataFrame) -> DataFrame:
    return rows.where((F.size("_prompt") % 2 == 1) & (F.size("_response") == 1))


def valid_pairs(rows: DataFrame) -> DataFrame:
    return rows.where((F.size("_prompt") % 2 == 1) & (F.size("_response") >= 2))


def valid_prompts(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("_prompt") % 2 == 1)


# ---- the second format: messages with typed content and weights


def weighted(role: Column | str, text: Column, weight: Column | float) -> Column:
    parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("value")))
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), parts.alias("content"), (F.lit(float(weight)) if isinstance(weight, int | float) else weight).alias("loss_weight"))


def v1_alpaca(rows: DataFrame) -> DataFrame:
    """messages of system, user (instruction and input put together) and assistant; only the last has weight."""
    get = lambda n: text_of(rows, n)
    asked = F.concat(get("instruction"), get("input"))
    said = [F.when(get("system") != "", weighted("system", get("system"), 0)), F.when(asked != "", weighted("user", asked, 0)), F.when(get("output") != "", weighted("assistant", get("output"), 1))]
    return rows.select(F.array_compact(F.array(*said)).alias("messages"))


def v1_pair(rows: DataFrame) -> DataFrame:
    """chosen_messages and rejected_messages of rows with chosen and rejected lists; unknown roles drop out."""
    roles = {"system": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant"}

    def side(name: str) -> Column:
        names = rows.schema[name].dataType.elementType.names
        who, what = ("from", "value") if "from" in names else ("role", "content")
        known = F.filter(name, lambda m: m[who].isin(*roles))
        return F.transform(known, lambda m: weighted(mapped(m[who], roles), m[what], F.when(m[who].isin("gpt", "assistant"), 1.0).otherwise(0.0)))

    return rows.select(side("chosen").alias("chosen_messages"), side("rejected").alias("rejected_messages"))


V1_CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"alpaca": v1_alpaca, "pair": v1_pair}


def v1_convert(rows: DataFrame, dataset: str, converter: str | None = None) -> DataFrame:
    if converter is not None and converter not in V1_CONVERTERS:
        raise ValueError(f"unknown converter {converter}")
    out = V1_CONVERTERS[converter](rows) if converter else rows
    return out.withColumn("_dataset_name", F.lit(dataset))


def valid_request(messages: Column) -> Column:
    """A request: messages of (role, content), after a leading system one an odd number that alternates from the user."""
    system = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    rest = F.when(system, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    roles = F.transform(rest, lambda m: message(F.when(m["role"] == "tool", OBSERVATION).otherwise(m["role"]), m["content"]))
    return F.coalesce((F.size(rest) % 2 == 1) & alternates(roles), F.lit(False))
