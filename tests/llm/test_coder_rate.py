"""What the coder makes of the given texts: fewer bits an id than the ids' own frequencies would need, in blocks of every size."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tessera.llm.queries import BYTE_BPE
from tessera.llm.range_coder import decode_block, encode_block


@pytest.fixture(scope="module")
def ids():
    library, out = Tokenizer.from_file(BYTE_BPE), []
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        out += [*library.encode(t or "", add_special_tokens=False).ids, 0]
    return np.array(out, np.uint32)


@pytest.mark.parametrize("n", [1 << 16, 1 << 18])
def test_below_order_zero(ids, n):
    some, vocabulary = ids[:n], int(ids.max()) + 1
    share = np.bincount(some)
    share = share[share > 0] / n
    data = encode_block(some, vocabulary)
    assert len(some) == n and 8 * len(data) / n < -(share * np.log2(share)).sum() and np.array_equal(decode_block(data, vocabulary), some)
