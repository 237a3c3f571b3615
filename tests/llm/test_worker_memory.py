"""What a Python worker holds after and during a task."""

import gc
import weakref

import pyarrow as pa

from sigevents.llm import tokens
from sigevents.llm.common import tidied


def test_a_task_of_another_kind_drops_the_encoders():
    batch = pa.RecordBatch.from_pydict({"x": [1, 2, 3]})
    held = weakref.ref(tokens.encoder("byte_bpe_50k.json", 10))
    assert list(tidied(lambda batches: batches, keep=tokens.KEPT)(iter([batch]))) == [batch]
    gc.collect()
    assert held() is tokens.encoder("byte_bpe_50k.json", 10)
    assert list(tidied(lambda batches: batches)(iter([batch]))) == [batch]
    gc.collect()
    assert held() is None


def test_large_results_leave_in_slices():
    batch = pa.RecordBatch.from_pydict({"x": [bytes([i]) * 1000 for i in range(100)]})
    got = list(tidied(lambda batches: batches, most=10_000)(iter([batch])))
    assert max(b.nbytes for b in got) < 15_000 and pa.Table.from_batches(got).column("x").to_pylist() == batch.column("x").to_pylist()
    empty = batch.slice(0, 0)
    assert [b.num_rows for b in tidied(lambda batches: batches, most=10)(iter([empty]))] == [0]
