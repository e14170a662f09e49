"""Autoregressive decoding behind a step model: prefill, then a token a step.

The loop owns the position counter, the stop rules and the choice; the model owns its cache,
which every sequence starts by clearing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

DECODED = "tokens array<bigint>, confidences array<float>, status string, error string"


class StepModel(Protocol):
    def clear(self) -> None:
        """Forgets the sequence so far."""

    def step(self, tokens: Sequence[int], offset: int) -> np.ndarray:
        """Logits after the tokens, whose first stands at ``offset``."""


@dataclass(frozen=True)
class Rules:
    limit: int = 1024  # new tokens, the first included
    end: int | None = None  # stops after this token
    suffix: tuple[int, ...] = ()  # stops where the new tokens end with these
    penalty: float = 1.0
    window: int = 64  # of tokens, prompt included, that the penalty looks at
    barred: tuple[int, ...] = ()  # never chosen from the second step on


def chosen(logits: np.ndarray) -> tuple[int, float]:
    """The first largest, NaN left out, and its softmax probability; (0, 0) without numbers."""
    held = np.where(np.isnan(logits), -np.inf, logits)
    at = int(held.argmax())
    if not np.isfinite(held[at]):
        return 0, 0.0
    return at, float(1 / np.exp(held - held[at]).sum())


def generate(model: StepModel, prompt: Sequence[int], rules: Rules) -> tuple[list[int], list[float]]:
    """The new tokens with their probabilities; an empty prompt is an error."""
    if not len(prompt):
        raise ValueError("empty prompt")
    model.clear()
    tokens, sure, fed, offset = list(prompt), [], list(prompt), 0
    made: list[int] = []
    while len(made) < rules.limit:
        logits = np.array(model.step(fed, offset), np.float64)
        offset += len(fed)
        if rules.penalty != 1.0:
            recent = np.unique(tokens[-rules.window :])
            logits[recent] = np.where(logits[recent] >= 0, logits[recent] / rules.penalty, logits[recent] * rules.penalty)
        if made and rules.barred:
            logits[list(rules.barred)] = -np.inf
        token, p = chosen(logits)
        fed = [token]
        made.append(token)
        tokens.append(token)
        sure.append(p)
        if token == rules.end or rules.suffix and tuple(made[-len(rules.suffix) :]) == rules.suffix:
            break
    return made, sure


class TableModel:
    """A stand-in whose logits follow from the last token: row t of a table.  It holds the
    sequence, as a cache does, and refuses a wrong position."""

    def __init__(self, table) -> None:
        self.table, self.cache = np.asarray(table, np.float64), []

    def clear(self) -> None:
        self.cache = []

    def step(self, tokens, offset):
        if offset != len(self.cache):
            raise ValueError("position and cache differ")
        self.cache += tokens
        return self.table[self.cache[-1]]


def decode(prompts: DataFrame, factory: Callable[[], StepModel], rules: Rules) -> DataFrame:
    """prompts (id, prompt) to id, tokens, confidences, status, error; a failing row keeps its error."""
    kept: dict = {}

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for i, prompt in zip(batch["id"], batch["prompt"], strict=True):
                if "model" not in kept:
                    kept["model"] = factory()
                try:
                    rows.append((i, *generate(kept["model"], [int(t) for t in (() if prompt is None else prompt)], rules), "ok", None))
                except Exception as e:  # one row's failure stays that row's
                    rows.append((i, None, None, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["id", "tokens", "confidences", "status", "error"])

    kind = dict(prompts.dtypes)["id"]
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, {DECODED}")


def device(cuda: bool, metal: bool) -> tuple[str, str]:
    """(device, number type): CUDA before Metal before the processor, always bfloat16."""
    return ("cuda" if cuda else "metal" if metal else "cpu"), "bfloat16"


def model_profile(gpus: int = 0, cores: int = 1):
    """A resource profile for stages that hold a model: so many GPUs and cores a task."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    tasks, executors = TaskResourceRequests().cpus(cores), ExecutorResourceRequests().cores(cores)
    if gpus:
        tasks, executors = tasks.resource("gpu", gpus), executors.resource("gpu", gpus)
    return ResourceProfileBuilder().require(executors).require(tasks).build
