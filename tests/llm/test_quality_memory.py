"""A task of the quality stage passes pairs on before they take much memory, and loses none."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from meshloom.llm import perplexity, textkernel


def test_pairs_are_passed_on_in_small_parts():
    texts = [" ".join(f"w{i % 97}x{j % 1013}" for j in range(3000)) for i in range(400)]
    known = np.unique(textkernel.Words(texts[:5], lower=False).hash)
    words = SimpleNamespace(value=perplexity.Vocabulary(known, np.zeros(perplexity.FIRST)))
    rows = list(perplexity._count_pairs(words, [0, 1])(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    held = [sum(perplexity._unpack(r["n"], r["size"], np.int64).sum() for r in rb.to_pylist()) for rb in rows]
    assert sum(held) == 400 * 3000 and max(held) < 700_000
