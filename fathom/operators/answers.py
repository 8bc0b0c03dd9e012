"""Extractive answers, prompts, transcripts, and the interface of a generator."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions.text import preview, sentences


def extractive(contexts: Column, n: int = 3) -> Column:
    """The first ``n`` sentences over contexts in order."""
    every = F.flatten(F.transform(contexts, lambda c: sentences(F.coalesce(c, F.lit("")))))
    return F.array_join(F.slice(every, 1, n), " ")


def answer_prompt(contexts: Column, query: Column, language: str = "English") -> Column:
    """A question with its first three contexts, numbered, under fixed rules."""
    shown = F.array_join(F.transform(F.slice(contexts, 1, 3), lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c, F.lit("\n"))), "")
    rules = f"Answer from the numbered passages alone and in {language}. Say so if they do not hold the answer."
    return F.concat(F.lit(f"<system>\n{rules}\n</system>\n<passages>\n"), shown, F.lit("</passages>\n<question>\n"), query, F.lit("\n</question>\n<answer>\n"))


def code_prompt(contexts: Column, query: Column, language: str = "English") -> Column:
    """A question about code with every context."""
    shown = F.when(F.size(contexts) == 0, F.lit("[No context retrieved]")).otherwise(F.array_join(contexts, "\n\n"))
    return F.concat(F.lit(f"Explain from the code below alone, in {language}.\n\nCode:\n"), shown, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def transcript(setting: Column, query: Column, docs: Column, answer: Column) -> Column:
    """What was asked, what was found (array of rank, source_file, text) and what was answered."""
    found = F.array_join(F.transform(docs, lambda d: F.concat(F.lit("#"), d["rank"].cast("string"), F.lit(" "), d["source_file"], F.lit(": "), preview(d["text"], 200))), "\n")
    return F.concat_ws("\n", F.concat(F.lit("setting: "), setting), F.concat(F.lit("query: "), query), F.lit("retrieved:"), found, F.lit("answer:"), answer)


class Generator(Protocol):
    """Answers prompts. ``model_id`` goes into the record."""

    model_id: str

    def __call__(self, prompt: str) -> str: ...


def with_retries(call: Callable[[str], str], attempts: int = 5, wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call`` again after failures, each wait twice the one before; an empty answer in the end."""

    def run(prompt: str) -> str:
        for n in range(attempts):
            try:
                return call(prompt)
            except Exception:
                if n + 1 < attempts:
                    sleep(wait * 2**n)
        return ""

    return run


GENERATION = "response string, prompt_token_count long, response_token_count long, latency_sec double, throughput_tokens_per_sec double, model_id string, error string"


_made: dict[tuple[str, str], Generator] = {}


def _generator(make: Callable[[], Generator]) -> Generator:
    """What ``make`` makes, once in the life of a worker, if it can be told by its name; the last such
    one is held. Functions without a name of their own are called anew."""
    name = (getattr(make, "__module__", "") or "", getattr(make, "__qualname__", "") or "<")
    if "<" in name[1]:
        return make()
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]


def generate(prompts: DataFrame, make: Callable[[], Generator], id_col: str = "qid", prompt: str = "prompt") -> DataFrame:
    """(qid, response, counts, latency, throughput, error): a generator, made once a worker, over Arrow
    batches. A failure is that row's error, not the job's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _generator(make)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                began, said, error = time.perf_counter(), None, None
                try:
                    said = model(text or "")
                except Exception as e:  # recorded with the row
                    error = f"{type(e).__name__}: {e}"
                took = time.perf_counter() - began
                n = len((said or "").split())
                out.append({"response": said, "prompt_token_count": len((text or "").split()), "response_token_count": n, "latency_sec": took, "throughput_tokens_per_sec": n / took if took > 0 else 0.0, "model_id": model.model_id, "error": error})
            kinds = {"response": pa.string(), "prompt_token_count": pa.int64(), "response_token_count": pa.int64(), "latency_sec": pa.float64(), "throughput_tokens_per_sec": pa.float64(), "model_id": pa.string(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], t) for k, t in kinds.items()]], names=[id_col, *kinds])

    return prompts.select(id_col, prompt).mapInArrow(run, f"`{id_col}` {prompts.schema[id_col].dataType.simpleString()}, {GENERATION}")


class FirstSentences:
    """The default generator: the first sentences of the passages that a prompt shows. No model, no network."""

    model_id = "extractive"

    def __init__(self, n: int = 3):
        self.n = n

    def __call__(self, prompt: str) -> str:
        shown = prompt.partition("<passages>\n")[2].partition("</passages>")[0] or prompt
        plain = re.sub(r"(?m)^\[\d+\] ", "", shown).strip()
        return " ".join([x for x in re.split(r"(?<=[.!?])\s+", plain) if x][: self.n])


ANSWER_MODES = ("extractive", "generate")


def answer_rows(contexts: DataFrame, mode: str = "extractive", make: Callable[[], Generator] = FirstSentences, n: int = 3) -> DataFrame:
    """(qid, answer, error) for rows (qid, query, contexts): sentences of the contexts, or what a
    generator, made once a worker, says to a prompt with them. An unknown mode is refused."""
    if mode not in ANSWER_MODES:
        raise ValueError(f"answer mode {mode!r} is none of {ANSWER_MODES}")
    if mode == "extractive":
        return contexts.select("qid", extractive(F.col("contexts"), n).alias("answer"), F.lit(None).cast("string").alias("error"))
    prompts = contexts.select("qid", answer_prompt(F.col("contexts"), F.col("query")).alias("prompt"))
    return generate(prompts, make).select("qid", F.col("response").alias("answer"), "error")
