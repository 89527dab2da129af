import numpy as np
import pytest
from stacksift.llm import separators


def brute(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("block", [1, 7, 64])
def test_stitching(spark, block, monkeypatch):
    monkeypatch.setattr(separators, "CHUNK_BLOCKS", 3)
    rng = np.random.default_rng(block)
    files = [
        rng.integers(0, 4, 300), np.array([9, 9, 9]), np.zeros(200, int), np.array([], int), np.full(50, 9),
        np.r_[np.zeros(60, int), 9],
    ]
    files = [np.where(f == 3, 9, f) for f in files]
    rows = [
        (n, b, ids[b * block : (b + 1) * block].astype("<u2").tobytes())
        for n, ids in enumerate(files) for b in range(-(-len(ids) // block))
    ]
    blocks = spark.createDataFrame(rows, "file long, block long, ids binary").repartition(3)
    got = sorted(map(tuple, separators.count_tokens(blocks, 9).collect()))
    assert got == sorted((n, *x) for n, ids in enumerate(files) for x in brute(ids.tolist(), 9))


def test_files_and_documents(spark):
    from tokenizers import Tokenizer

    from stacksift.llm.tokens import vocabulary

    ids = np.array([1, 2, 9, 9, 3], "<u2").tobytes()
    files = spark.createDataFrame([("a", ids), ("b", b"")], "path string, content binary")
    blocks = separators.block_rows(files, 2, 2)
    got = sorted(tuple(r)[1:] for r in separators.count_tokens(blocks, 9).collect())
    assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]
    texts = [None, "", "one two", "<|endoftext|>", "long " * 70000, "one two"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, file int").repartition(2)
    plain = Tokenizer.from_file(vocabulary()[0])
    plain.encode_special_tokens = True
    wanted = {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in separators.document_tokens(docs).collect()} == wanted
    assert separators.document_tokens(docs.limit(0)).collect() == []
