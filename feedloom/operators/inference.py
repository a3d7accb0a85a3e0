"""Model providers and the operators that call them.

A provider is made by a picklable factory, once per Python worker, so a model is
loaded once and not per batch. Calls are retried with growing pauses, and a
failing row yields an error text while the others go on.

A failure counts as the row's own only if the provider answers something else: after some failures in a row, and after the
last rows of a task's batch if those failed, a text that was answered before is sent again. If that fails too, the provider
is down and the task fails, so nothing is stored and the batch comes again, by Spark's retries or with the next poll.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.answers import (
    SYSTEM_PROMPT,
    USER_PROMPT_HEAD,
    USER_PROMPT_TAIL,
    parse_classification,
    render_prompt,
    render_repair_prompt,
)
from feedloom.functions.text import as_column

# Attempts per call and seconds between them.
ATTEMPTS = 3
FIRST_PAUSE = 1.0
LONGEST_PAUSE = 10.0


# Texts in one request, and chat requests that a task keeps going at once.
BATCH_SIZE = 256
# A request for vectors ends with the text that brings it to so many bytes; whoever embeds works on these at once.
REQUEST_BYTES = 1 << 20
CONCURRENCY = 8
# After so many single texts in a row that failed, the provider is asked for one that it should be able to answer.
FAILURES_TO_STOP = 16
# Sent to learn whether a provider is up that has not answered any text yet.
PROBE = "text"


class ProviderDown(RuntimeError):
    """The provider answers nothing, not even what it answered before."""


class ChatProvider(Protocol):
    """A provider may also have ``chat_many(conversations, max_tokens)``, which answers a list in its order."""

    def chat(self, messages: list[dict[str, str]], max_tokens: int) -> str: ...


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[Sequence[float]]: ...


class Gate:
    """Counts requests that failed in a row, over all threads of a task, and asks whether the provider is up."""

    def __init__(self, limit: int, pause: Callable[[float], None]) -> None:
        self.limit, self.failed, self.reason, self.pause = limit, 0, "", pause

    def note(self, error: Exception | None) -> None:
        self.failed = 0 if error is None else self.failed + 1
        if error is not None:
            self.reason = described(error)

    def check(self, known_good: Callable[[], Any], at_end: bool = False) -> None:
        """After ``limit`` failures in a row, or after any ``at_end``: fail unless the provider answers ``known_good``."""
        if self.failed >= (1 if at_end else self.limit):
            try:
                call_with_retry(known_good, self.pause)
            except Exception as exc:
                raise ProviderDown(f"{self.reason}; then {described(exc)} for a text that should be answered") from exc
            self.failed = 0


def described(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def call_with_retry(call: Callable[[], Any], pause: Callable[[float], None] = time.sleep) -> Any:
    """Run ``call`` up to three times, waiting 1 s, 2 s, ... (at most 10 s); the last error is raised."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call()
        except Exception:
            if attempt == ATTEMPTS:
                raise
            pause(min(LONGEST_PAUSE, max(FIRST_PAUSE, FIRST_PAUSE * 2 ** (attempt - 1))))


def ask(
    messages: Column | str,
    provider: Callable[[], ChatProvider],
    max_tokens: int = 300,
    pause: Callable[[float], None] = time.sleep,
    concurrency: int = CONCURRENCY,
    batch_size: int = BATCH_SIZE,
) -> Column:
    """struct(answer, error) of a model's reply; NULL messages are not sent.

    A provider with ``chat_many`` gets lists of at most ``batch_size`` conversations; when a list fails, each of
    its conversations is asked by itself. Otherwise ``concurrency`` conversations are under way at once. Raises
    ``ProviderDown`` when failures are not the conversations' own.
    """
    at_once = max(FAILURES_TO_STOP, concurrency)

    def sent(turns: Any) -> list[dict[str, str]]:
        return [{"role": t["role"], "content": t["content"]} for t in turns]

    def answered(answer: str | None) -> str:
        if answer is None:
            raise ValueError("empty answer")
        return answer

    def one(client: ChatProvider, turns: list[dict[str, str]], gate: Gate) -> tuple[str | None, str | None]:
        try:
            answer = call_with_retry(lambda: answered(client.chat(turns, max_tokens)), gate.pause)
        except Exception as exc:
            if not isinstance(exc, ValueError):
                gate.note(exc)
            return None, described(exc)
        gate.note(None)
        return answer, None

    def many(client: Any, turns: list, gate: Gate) -> list[tuple[str | None, str | None]]:
        def call() -> list[str]:
            answers = list(client.chat_many(turns, max_tokens))
            if len(answers) != len(turns):
                raise RuntimeError(f"{len(answers)} answers to {len(turns)} conversations")
            return answers

        try:
            answers = call_with_retry(call, gate.pause)
        except Exception:
            return [one(client, t, gate) for t in turns]
        gate.note(None)
        return [(a, None if a is not None else "ValueError: empty answer") for a in answers]

    @F.pandas_udf("answer string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client, gate = provider(), Gate(FAILURES_TO_STOP, pause)
        known = [probe_messages()]

        def known_good() -> Any:
            return answered(client.chat(known[0], max_tokens))

        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for batch in batches:
                rows = [i for i, turns in enumerate(batch) if turns is not None]
                turns = [sent(batch.iloc[i]) for i in rows]
                lists = hasattr(client, "chat_many")
                step = batch_size if lists else at_once
                replies = []
                for i in range(0, len(turns), step):
                    part = turns[i : i + step]
                    new = many(client, part, gate) if lists else list(pool.map(lambda t: one(client, t, gate), part))
                    known[0] = next((t for t, (_, error) in zip(part, new) if error is None), known[0])
                    gate.check(known_good)
                    replies += new
                gate.check(known_good, at_end=True)
                out: list[tuple[str | None, str | None]] = [(None, None)] * len(batch)
                for i, reply in zip(rows, replies):
                    out[i] = reply
                yield pd.DataFrame(out, columns=["answer", "error"])

    return run.asNondeterministic()(as_column(messages))


def probe_messages() -> list[dict[str, str]]:
    return [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": USER_PROMPT_HEAD + PROBE + USER_PROMPT_TAIL}]


def classify_two_pass(
    df: DataFrame,
    provider: Callable[[], ChatProvider],
    text: str = "text",
    max_tokens: int = 300,
    pause: Callable[[float], None] = time.sleep,
    concurrency: int = CONCURRENCY,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add ``classification`` (NULL when it failed), ``classification_error`` and ``asked_twice``.

    The second question goes only to rows whose first answer did not validate;
    empty text is never sent.
    """
    prompt = F.when(F.length(text) > 0, render_prompt(text))
    first = (
        df.withColumn("_prompt", prompt)
        .withColumn("_first", ask("_prompt", provider, max_tokens, pause, concurrency, batch_size))
        .withColumn("_parsed", parse_classification("_first.answer"))
    )
    rejected = F.col("_first.answer").isNotNull() & F.col("_parsed").isNull()
    second = (
        first.withColumn("asked_twice", rejected)
        .withColumn("_repair", F.when(F.col("asked_twice"), render_repair_prompt("_prompt")))
        .withColumn("_second", ask("_repair", provider, max_tokens, pause, concurrency, batch_size))
        .withColumn("classification", F.coalesce("_parsed", parse_classification("_second.answer")))
    )
    error = F.when(
        F.col("classification").isNull() & (F.length(text) > 0),
        F.coalesce("_first.error", "_second.error", F.lit("answer does not match the schema")),
    )
    return second.withColumn("classification_error", error).drop(
        "_prompt", "_first", "_parsed", "_repair", "_second"
    )


def embed(
    text: Column | str,
    provider: Callable[[], EmbeddingProvider],
    pause: Callable[[float], None] = time.sleep,
    batch_size: int = BATCH_SIZE,
) -> Column:
    """struct(embedding, error) of texts, at most ``batch_size`` in a request and not many more bytes than ``REQUEST_BYTES``.

    NULL and empty texts are not sent and get NULL. When a request fails, or returns another number of vectors, its
    halves are sent, so that only the bad texts stay without a vector. Raises ``ProviderDown`` when failures are not the
    texts' own. A provider may name the size of its requests itself (``batch_size``).
    """

    def call(client: EmbeddingProvider, texts: list[str]) -> list[Any]:
        vectors = list(client.embed(texts))
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors

    def each(client: EmbeddingProvider, texts: list[str], gate: Gate, first: bool, known: list[str]) -> list[tuple[Any, str | None]]:
        try:
            # Only a whole request is repeated; its parts are tried once.
            vectors = call_with_retry(lambda: call(client, texts), gate.pause) if first else call(client, texts)
        except Exception as exc:
            if len(texts) == 1:
                gate.note(exc)
                gate.check(lambda: call(client, known))
                return [(None, described(exc))]
            half = len(texts) // 2
            return each(client, texts[:half], gate, False, known) + each(client, texts[half:], gate, False, known)
        gate.note(None)
        known[0] = texts[0]
        return [(v, None) for v in vectors]

    @F.arrow_udf("embedding array<float>, error string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client, gate, known = provider(), Gate(FAILURES_TO_STOP, pause), [PROBE]
        size = getattr(client, "batch_size", batch_size)
        for batch in batches:
            vectors: list[Any] = [None] * len(batch)
            errors: list[str | None] = [None] * len(batch)
            lengths = pc.fill_null(pc.binary_length(batch), 0).to_numpy(False)
            rows = np.flatnonzero(lengths > 0)
            for part in requests(rows, lengths, size):
                for i, (v, e) in zip(part, each(client, batch.take(pa.array(part)).to_pylist(), gate, True, known)):
                    vectors[i], errors[i] = v, e
            gate.check(lambda: call(client, known), at_end=True)
            yield pa.StructArray.from_arrays(
                [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                names=["embedding", "error"],
            )

    return run.asNondeterministic()(as_column(text))


def requests(rows: np.ndarray, lengths: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The rows in order, in parts of at most ``size``; a part ends with the row that brings it to ``REQUEST_BYTES``."""
    before = np.concatenate([[0], np.cumsum(lengths[rows], dtype=np.int64)])
    first = 0
    while first < len(rows):
        full = int(np.searchsorted(before, before[first] + REQUEST_BYTES))
        end = min(first + size, full, len(rows))
        yield rows[first:end]
        first = end


WORD_BREAK = r"[^\pL\pN]+"


@lru_cache(maxsize=1 << 16)
def hashed(word: str) -> int:
    """The first 32 bits of the word's MD5; frequent words are met in every request."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


class HashingEmbedder:
    """Bag of words hashed into ``dim`` buckets, scaled to unit length; needs no model."""

    # Nothing is sent anywhere, so the bytes alone bound what is taken at once.
    batch_size = 1 << 16

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[Sequence[float]]:
        words = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), WORD_BREAK)
        coded = words.flatten().dictionary_encode()
        buckets = np.array([hashed(w) % self.dim if w else -1 for w in coded.dictionary.to_pylist()], dtype=np.int64)[np.asarray(coded.indices)]
        owner = np.repeat(np.arange(len(texts)), np.asarray(words.value_lengths()))
        used = buckets >= 0
        counts = np.bincount(
            owner[used] * self.dim + buckets[used], minlength=len(texts) * self.dim
        ).reshape(len(texts), self.dim)
        norms = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        return list(np.divide(counts, norms, out=np.zeros(counts.shape), where=norms != 0).astype(np.float32))
