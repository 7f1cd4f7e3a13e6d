"""What Python holds of a block while it is packed, cut into words and cut at its repeats."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from shoebox.llm import blocks as B
from shoebox.llm import suffix_dedup

from .test_llm_documents import prose


def held(f):
    """What f returns, and the MB of Python's and numpy's that it held at once beyond what was there."""
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most / 1e6


def texts(n, size=400):
    own = [prose(k, size).encode() for k in range(20)]
    return [own[k % 20] + b" %d" % k for k in range(n)]


def test_texts_of_a_batch_are_not_copied_to_be_packed():
    data = texts(8000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array(data, pa.binary()), pa.array([k % 100 for k in range(8000)], pa.int32())], ["doc_id", "text", "block"])
    out, most = held(lambda: list(B._pack(iter([batch]), 3)))
    assert most < batch.nbytes / 1e6 / 2
    payloads = {b: p for b, p in zip(out[0].column(0).to_pylist(), out[0].column(1).to_pylist(), strict=True)}
    assert len(payloads) == 100
    for block, payload in payloads.items():
        ids, own = B.documents_in(pa.chunked_array([pa.array([payload], pa.binary())]))
        assert ids == list(range(block, 8000, 100)) and own == [data[k] for k in ids]


def test_words_of_a_block_are_numbered_a_run_at_a_time():
    data = [b"", *texts(2000, 800), b" ", b"", b"x" * 3_000_000, b"last one"]
    (words, codes, sizes), most = held(lambda: B.coded(data, B.blank_separated))
    assert most < 6 * sum(map(len, data)) / 1e6
    all_words, all_codes, all_sizes = B.coded(data, B.blank_separated, 1 << 40)
    assert words.equals(all_words) and (codes == all_codes).all() and (sizes == all_sizes).all()
    assert [w.as_py() for w in words.take(pa.array(codes))] == [w for t in data for w in t.split()]
    assert [len(x) for x in B.coded([], B.blank_separated)] == [0, 0, 0]


def test_answers_are_laid_out_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 4, 50)
    arrays = [[lengths[:20], np.arange(lengths[:20].sum())], [lengths[20:], 1000 + np.arange(lengths[20:].sum())]]
    codes, place = rng.integers(0, 50, 1000), rng.permutation(50)
    n, values = B.spread(codes, place, arrays)
    monkeypatch.setattr(B, "POSITIONS", 7)
    n2, values2 = B.spread(codes, place, arrays)
    flat, starts = np.concatenate([a[1] for a in arrays]), np.cumsum(lengths) - lengths
    assert (n == n2).all() and (values == values2).all()
    assert values.tolist() == [int(v) for c in codes for v in flat[starts[place[c]] : starts[place[c]] + lengths[place[c]]]]


@pytest.mark.parametrize("size", [0, 1, 99, 100, 101, 250, 5000])
def test_covered_bytes(size):
    rng, most = np.random.default_rng(size), max(0, size - suffix_dedup.SPAN + 1)
    for _ in range(50):
        cuts = np.unique(rng.integers(0, most + 1, rng.integers(2, 12)))
        some = rng.random(len(cuts) - 1) < 0.5
        first, last = cuts[:-1][some], cuts[1:][some] - 1
        single = rng.integers(0, max(1, most), rng.integers(0, 6) if most else 0).astype(np.uint32)
        want = np.zeros(size, bool)
        for s in [*single.tolist(), *(s for a, b in zip(first, last, strict=True) for s in range(a, b + 1))]:
            want[s : s + suffix_dedup.SPAN] = True
        assert (suffix_dedup.covered((first, last), single, size) == want).all()


def test_covered_bytes_take_no_eight_bytes_each():
    size = 4 << 20
    _, most = held(lambda: suffix_dedup.covered((np.arange(0, size - 2000, 1000), np.arange(900, size - 1100, 1000)), np.array([5], np.uint32), size))
    assert most < 8 * size / 1e6


def test_texts_that_are_cut_come_from_the_task_that_cuts_them(spark):
    again = "é" * 49 + prose(9, 60)
    rows = [(k, prose(100 + k, 80) + again[k:] + prose(200 + k, 80)) for k in range(12)] + [(None, again), (None, None), (3, "short"), (1, again)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two = suffix_dedup.kept_texts(suffix_dedup.cut_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "if(n_removed > 0, kept, null) kept", "text_hash"))
    one = suffix_dedup.cut_texts(docs)
    key = lambda df: sorted(map(repr, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "text", "text_hash").collect()))
    assert key(one) == key(two)
    assert one.where("text IS NOT NULL").count() > 5 and one.where("text IS NULL").count() > 1
    assert "MapInArrow" not in one._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
