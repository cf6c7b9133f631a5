"""Work buffers of the search tasks stay bounded whatever the size of a batch or shard."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lexiforge.operators import postings
from lexiforge.operators.retrieval import _bm25_topk_fn, token_slices


def _batch(n_docs, n_tokens, vocab):
    at = np.random.default_rng(1).integers(0, len(vocab), n_docs * n_tokens)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1) * n_tokens, pa.int32()), pa.array(vocab).take(pa.array(at)))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n_docs)), lists], names=["id", "_t"])


def test_token_slices_cover_all_rows_within_bounds():
    lengths = np.array([3, 0, 9, 1, 1, 1, 1, 0, 2])
    got = list(token_slices(lengths, 4, 3))
    assert [a for a, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1].tolist()] and sum(n for _, n in got) == 9
    assert all(n <= 3 and (n == 1 or lengths[a:a + n].sum() <= 4) for a, n in got)
    assert list(token_slices(np.array([], int), 4, 3)) == []


def test_bm25_scan_holds_a_slice_of_a_large_batch():
    vocab, queries = [f"w{i}" for i in range(200)], 50
    args = (vocab, np.ones(200), np.arange(201) * 5, np.arange(1000) % queries, np.ones(1000, int),
            list(range(queries)), pa.int64(), 300.0, 5)
    batch = _batch(8000, 300, vocab)
    tracemalloc.start()
    whole = list(_bm25_topk_fn(*args)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    parts = list(_bm25_topk_fn(*args)(iter([batch.slice(a, 100) for a in range(0, 8000, 100)])))
    assert [b.to_pydict() for b in whole] == [b.to_pydict() for b in parts]


def test_shard_rows_hold_little_per_posting():
    n = 1_000_000
    rng = np.random.default_rng(2)
    code, doc, tf = (rng.integers(0, m, n).astype(np.int32) for m in (500, 4000, 9))
    lens = np.full(4000, 250)
    tokens = [f"t{i}" for i in range(500)]
    rows = postings._shard_rows(0, list(range(4000)), lens, tokens, code, doc, tf, pa.int64(), 512)
    next(rows)
    tracemalloc.start()
    got = sum(sum(b.column(3).to_pylist()) for b in rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and peak < 35 * n
