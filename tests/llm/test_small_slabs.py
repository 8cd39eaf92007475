"""Encoders of other sizes give the same ids and hold less."""

import pyarrow as pa

from quern.llm import _tokens, packing
from quern.llm.queries import vocabulary


def test_small_memo_and_slabs():
    path = vocabulary("word_bpe_49k.json")
    texts = pa.array([f"word{k} Other{k % 7}, the {k * k}." for k in range(2_000)] + ["", None])
    small = _tokens.ChunkEncoder(path, memo_chunks=50, slab_bytes=1_000)
    assert len(list(small.slabs(texts))) > 20
    ids, counts = small.encode(texts)
    want, n = _tokens.ChunkEncoder(path).encode(texts)
    assert ids.tolist() == want.tolist() and counts.tolist() == n.tolist()
    assert len(small.memo) + len(small.old) < 1_000
    assert packing.MEMO_CHUNKS < _tokens.MEMO_CHUNKS and packing.SLAB_BYTES < _tokens.SLAB_BYTES
