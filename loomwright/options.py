"""Options of the data side and their checks."""

from __future__ import annotations

from dataclasses import dataclass


def _list(x: str | list[str] | None) -> list[str] | None:
    return [p.strip() for p in x.split(",")] if isinstance(x, str) else x


@dataclass(frozen=True)
class DataOptions:
    """What to read and how to encode it; comma-separated texts become lists."""

    template: str | None = None
    dataset: str | list[str] | None = None
    eval_dataset: str | list[str] | None = None
    dataset_dir: str = "data"
    media_dir: str | None = None
    cutoff_len: int = 2048
    train_on_prompt: bool = False
    mask_history: bool = False
    streaming: bool = False
    buffer_size: int = 16384
    mix_strategy: str = "concat"
    interleave_probs: str | list[float] | None = None
    overwrite_cache: bool = False
    preprocessing_batch_size: int = 1000
    preprocessing_num_workers: int | None = None
    max_samples: int | None = None
    eval_num_beams: int | None = None
    ignore_pad_token_for_loss: bool = True
    val_size: float = 0.0
    eval_on_each_dataset: bool = False
    packing: bool | None = None
    neat_packing: bool = False
    tool_format: str | None = None
    default_system: str | None = None
    enable_thinking: bool | None = True
    tokenized_path: str | None = None
    data_shared_file_system: bool = False

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        for k in ("dataset", "eval_dataset"):
            put(k, _list(getattr(self, k)))
        if self.media_dir is None:
            put("media_dir", self.dataset_dir)
        if self.mix_strategy not in ("concat", "interleave_under", "interleave_over"):
            raise ValueError("unknown mix_strategy")
        if self.dataset is None and self.val_size > 0:
            raise ValueError("val_size needs a dataset")
        if self.eval_dataset is not None and self.val_size > 0:
            raise ValueError("either eval_dataset or val_size")
        if self.interleave_probs is not None:
            if self.mix_strategy == "concat":
                raise ValueError("interleave_probs is for interleaving")
            put("interleave_probs", [float(p) for p in _list(self.interleave_probs)] if isinstance(self.interleave_probs, str) else self.interleave_probs)
            for k in ("dataset", "eval_dataset"):
                if getattr(self, k) is not None and len(getattr(self, k)) != len(self.interleave_probs):
                    raise ValueError("as many interleave_probs as datasets are needed")
        if self.streaming and 1e-6 < self.val_size < 1:
            raise ValueError("a stream needs a whole number as val_size")
        if self.streaming and self.max_samples is not None:
            raise ValueError("max_samples is not for streams")
        if self.mask_history and self.train_on_prompt:
            raise ValueError("mask_history and train_on_prompt exclude each other")
        if self.neat_packing:
            put("packing", True)
        if self.packing:
            put("cutoff_len", self.cutoff_len - 1)

    def packs(self, stage: str) -> bool:
        return self.packing if self.packing is not None else stage == "pt"


def check_training(data: DataOptions, stage: str, max_steps: int = 0, generate: bool = False) -> None:
    """Rules between the data options and a run."""
    if data.streaming and max_steps <= 0:
        raise ValueError("a stream needs max_steps")
    if generate and stage != "sft":
        raise ValueError("generation is for sft only")
    if data.packing and stage not in ("pt", "sft"):
        raise ValueError("packing is for pt and sft only")


@dataclass(frozen=True)
class EvalOptions:
    task: str
    task_dir: str = "evaluation"
    batch_size: int = 4
    seed: int = 42
    lang: str = "en"
    n_shot: int = 5
    save_dir: str | None = None

    def __post_init__(self) -> None:
        if self.lang not in ("en", "zh"):
            raise ValueError("lang is en or zh")
