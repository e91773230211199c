from collections import Counter

import pyarrow as pa
import pytest

from meshloom.llm import divergence


@pytest.mark.parametrize("bounds", [{"TERMS": 20}, {"TERM_BYTES": 300}, {"ENTRIES": 30, "WORDS": 15}, {"WORDS": 15}])
def test_a_task_that_sends_tries_on_more_than_once_counts_the_same(monkeypatch, bounds):
    docs = [(f"w{chr(97 + i % 26)} common u{chr(97 + i // 26)}{'x' * (300 * (i % 9 == 0))} tail", f"l{i % 2}", f"s{i % 3}") for i in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs)], ["text", "lang", "source"])

    def counted():
        out, batches = Counter(), list(divergence._count(iter([batch])))
        for rb in batches:
            for i in range(rb.num_rows):
                trie, names = divergence._joined([divergence._Open(rb, i)])
                for k, t in enumerate(trie.terms):
                    for j in range(trie.begin[k], trie.begin[k + 1]):
                        out[rb.column(0)[i].as_py(), rb.column(1)[i].as_py() + t, names[trie.who[j]]] += int(trie.count[j])
        return out, len(batches)

    whole, once = counted()
    for bound, value in bounds.items():
        monkeypatch.setattr(divergence, bound, value)
    again, more = counted()
    assert again == whole and sum(whole.values()) == sum(len(t.split()) for t, _, _ in docs)
    assert more > once or len(bounds) == 1 and "WORDS" in bounds
