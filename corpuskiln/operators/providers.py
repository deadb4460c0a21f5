"""External models as callables over batches; failures become nulls and the operators decide what they mean."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A provider maps a list of texts to a list of results, None for a failure. It is made once for each task.
Provider = Callable[[list[str]], list]


def apply_provider(rows: DataFrame, make: Callable[[], Provider], text_col: str, out_col: str, out_type: str) -> DataFrame:
    """rows plus out_col from the provider; a batch that raises is tried row by row, and rows that raise get null."""

    @F.pandas_udf(out_type)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for texts in batches:
            items = ["" if t is None else t for t in texts]
            try:
                out = provider(items)
            except Exception:  # noqa: BLE001  any failure of a provider is a null
                out = []
                for item in items:
                    try:
                        out += provider([item])
                    except Exception:  # noqa: BLE001
                        out.append(None)
            yield pd.Series(out, dtype=object)

    # Nondeterministic: else a filter on the result is pushed below and every text is asked twice.
    return rows.withColumn(out_col, call.asNondeterministic()(F.col(text_col)))


def hash_embedder(dim: int = 64) -> Provider:
    """A stub for tests and offline runs: hashed word counts. It shows plumbing, not model quality."""

    def embed(texts: list[str]) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % dim] += 1
            out.append(v.tolist() if v.any() else None)
        return out

    return embed


def word_moderator(words: tuple[str, ...]) -> Provider:
    """A stub moderator: answers yes where a text holds one of the words."""
    return lambda texts: ["yes" if any(w in t.lower() for w in words) else "no" for t in texts]


def echo_generator() -> Provider:
    """A stub generator: one question/answer item about the first words of the prompt's last line."""
    import json

    def generate(texts: list[str]) -> list:
        first = [" ".join(t.strip().rsplit("\n", 1)[-1].split()[:8]) for t in texts]
        return ["```json\n" + json.dumps([{"question": f"What about {f}?", "thinking": "", "answer": f or "nothing"}]) + "\n```" for f in first]

    return generate
