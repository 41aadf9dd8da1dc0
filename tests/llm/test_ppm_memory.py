"""What a counting task of PPM holds does not grow with its rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from perkline.llm.ppm_score import ORDER, _bytes_of, _codes, _count, _Union, held_out


def test_ppm_count_is_bounded_and_whole():
    """Nearly ten million distinct events in one task: counts are passed on in parts, and the parts add up."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(48, 112, 1 << 18, np.uint8).tobytes().decode() for _ in range(38)]
    texts += texts[:2]
    ids = [i for i in range(99) if not held_out(i)][: len(texts)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t])], ["doc_id", "text"]) for i, t in zip(ids, texts, strict=True)]
    tracemalloc.start()
    for _ in _count(iter(batches)):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
    parts = [(b.column(1), b.column(2)) for b in _count(iter(batches)) if b.column(0)[0].as_py() == 1]
    got, n = (np.concatenate([p[k].to_numpy() for p in parts]) for k in (0, 1))
    want, counts = np.unique(np.concatenate([_codes(_bytes_of([t])) for t in texts]).view(np.int64), return_counts=True)
    order = np.argsort(got, kind="stable")
    distinct, starts = np.unique(got[order], return_index=True)
    assert len(want) > 9_000_000 and len(got) > len(want)
    assert np.array_equal(distinct, want) and np.array_equal(np.add.reduceat(n[order], starts), counts)
    assert n.sum() == sum(len(t) + 1 for t in texts) and ORDER == 5


def test_ppm_union_of_many_parts():
    rng = np.random.default_rng(6)
    parts = [np.unique(rng.integers(0, 5_000_000, 900_000).astype(np.uint64)) for _ in range(9)]
    union = _Union()
    for p in parts:
        union.add(p)
    assert np.array_equal(union.reduced(), np.unique(np.concatenate(parts)))
