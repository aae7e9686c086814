"""Named engines for recognition and text generation, with deterministic stand-ins for tests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENGINES: dict[str, Callable] = {}
_OPTIONS: dict[str, dict[str, type]] = {}
#: Temperature and most tokens of each task.
TASKS = {"summary": (0.3, 500), "extraction": (0.2, 1000), "classification": (0.2, 100), "qa": (0.3, 500)}


def register(name: str, **options: type) -> Callable:
    """Adds an engine under a name; options: what it can be configured with, {option: type}."""

    def add(engine: Callable) -> Callable:
        _ENGINES[name], _OPTIONS[name] = engine, options
        return engine

    return add


def engine(name: str) -> Callable:
    if name not in _ENGINES:
        raise ValueError(f"unknown engine {name!r}; there are {sorted(_ENGINES)}")
    return _ENGINES[name]


def configured(name: str, **given) -> Callable:
    """The engine with its options set; unknown ones and those of another type raise before anything runs."""
    call, known = engine(name), _OPTIONS[name]
    for option, value in given.items():
        if option not in known or not isinstance(value, known[option]):
            raise ValueError(f"engine {name!r} takes {known}, not {option}={value!r}")
    return partial(call, **given)


def is_chat_model(model: Column) -> Column:
    """Models that are spoken to by turns rather than by a prompt."""
    return F.contains(F.lower(model), F.lit("gpt"))


def retried(call: Callable, tries: int = 3, first_wait: float = 1.0) -> Callable:
    """The call, tried again after doubling waits; the last error goes up."""

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(first_wait * 2**n)

    return run


@register("echo")
def echo(prompt: str, temperature: float, most_tokens: int) -> str:
    """Stand-in for a language model: the first words of the prompt."""
    return " ".join(prompt.split()[:most_tokens])


@register("sentiment", positive=tuple, negative=tuple)
def sentiment(prompt: str, temperature: float, most_tokens: int, positive: tuple = ("good", "great"), negative: tuple = ("bad", "poor")) -> str:
    """Stand-in for a classifier: which of two lists has more of the prompt's words."""
    words = prompt.lower().split()
    balance = sum(w in positive for w in words) - sum(w in negative for w in words)
    return "positive" if balance > 0 else "negative" if balance < 0 else "neutral"


@register("pages")
def pages(content: bytes, kind: str) -> list[tuple[str, float]]:
    """Stand-in for recognition: the pages of a text file, cut at form feeds."""
    return [(page, 1.0) for page in content.decode("utf-8", "replace").split("\f")]


def generated(prompts: DataFrame, task: str, name: str = "echo", tries: int = 3, first_wait: float = 1.0, **options) -> DataFrame:
    """(document_id, prompt) with success, reply, error and token counts; a failing row is tried again and doesn't end the job. Unknown tasks, engines and options raise."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; there are {sorted(TASKS)}")
    call, (temperature, most) = retried(configured(name, **options), tries, first_wait), TASKS[task]

    @F.pandas_udf("success boolean, reply string, error string, prompt_tokens int, completion_tokens int")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch:
                try:
                    reply = call(prompt, temperature, most)
                    rows.append((True, reply, None, len(prompt.split()), len(reply.split())))
                except Exception as broken:  # noqa: BLE001
                    rows.append((False, None, str(broken), 0, 0))
            yield pd.DataFrame(rows, columns=["success", "reply", "error", "prompt_tokens", "completion_tokens"])

    return prompts.select("*", ask("prompt").alias("r")).select(*prompts.columns, "r.*")


def tokens_per_model(replies: DataFrame) -> DataFrame:
    """(model, prompt_tokens, completion_tokens) to the sum of each model."""
    return replies.groupBy("model").agg(F.sum(total_tokens(F.col("prompt_tokens"), F.col("completion_tokens"))).alias("tokens"))


def total_tokens(prompt: Column, completion: Column) -> Column:
    return F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))
