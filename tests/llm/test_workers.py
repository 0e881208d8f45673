"""What a Python worker holds after a task."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gridwise.llm import tokens, workers
from gridwise.llm.queries import vocabulary


def held() -> int:
    """MB of this process's own memory."""
    return sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024


def pieces(batches):
    """Leaves the C library with much freed memory below a little that lives on."""
    for batch in batches:
        rows = [np.ones(8_000) for _ in range(4_000)]
        kept.append(np.ones(8_000))
        del rows
        yield batch


kept: list[np.ndarray] = []


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_freed_memory_goes_back_after_the_last_batch():
    before = held()
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    assert list(workers.lean(pieces)([batch, batch])) == [batch, batch]
    assert held() - before < 100  # 244 without


def test_a_tokenizer_stays_open_for_its_own_tasks_only():
    path = vocabulary("word_bpe_49k.json")
    text = pa.array(["one two"])

    def encode(batches):
        for x in batches:
            yield from tokens.encode_all(path, x)

    list(workers.lean(encode, encoding=True)([text]))
    first = tokens.encoder(path)
    list(workers.lean(encode, encoding=True)([text]))
    assert tokens.encoder(path) is first
    list(workers.lean(iter)([text]))
    assert path not in tokens._open
