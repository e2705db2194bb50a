"""Answers of a language model to questions, parsed, verified and routed. The model is injected."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import cot_prompt, tag, verified


class Backend(Protocol):
    """Loaded once in each worker."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class Echo:
    """A backend for tests that answers nothing but a fixed text."""

    def __init__(self, text: str = "<reasoning>none</reasoning><final></final>"):
        self.text = text

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.text] * len(prompts)


def with_retries(call: Callable[[list[str]], list[str]], tries: int = 3, pause: float = 2.0) -> Callable[[list[str]], list[str]]:
    def run(prompts: list[str]) -> list[str]:
        for k in range(tries):
            try:
                return call(prompts)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(pause)
        return []

    return run


def generate(column, load: Callable[[], Backend]):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = load()
        for texts in batches:
            yield pd.Series(with_retries(backend.generate)(texts.tolist()), index=texts.index)

    return run(column)


def annotate(questions: DataFrame, load: Callable[[], Backend], need_prediction: bool = False) -> DataFrame:
    """The questions with raw_model_output, cot, final_pred, is_correct."""
    out = questions.withColumn("raw_model_output", generate(cot_prompt(F.col("question"), F.col("graph_support.edges")), load))
    out = out.withColumns({"cot": tag(F.col("raw_model_output"), "reasoning"), "final_pred": tag(F.col("raw_model_output"), "final")})
    return out.withColumn("is_correct", verified(F.col("final_pred"), F.col("answer"), need_prediction))


def without_edges(rows: DataFrame) -> DataFrame:
    return rows.withColumn("graph_support", F.col("graph_support").dropFields("edges"))
