import random
import zlib

import numpy as np
import pytest
from stacksift.llm import packing
from stacksift.llm.tokens import encoder, vocabulary


def ids_of(numbers):
    return np.array(numbers, "<u4").tobytes()


def check_windows(documents, windows, window):
    """Every id in exactly one piece, windows full or at a power of two."""
    seen = {}
    for pieces in windows:
        fill = sum(len(p[2]) // 4 for p in pieces)
        assert 0 < fill <= window
        assert fill == window or fill & (fill - 1) == 0
        for doc, start, ids, total in pieces:
            assert total == len(documents[doc]) // 4 and ids
            seen.setdefault(doc, []).append((start, ids))
    for doc, ids in documents.items():
        pieces = sorted(seen.pop(doc, []))
        at = 0
        for start, part in pieces:
            assert start == at
            at += len(part) // 4
        assert b"".join(p for _, p in pieces) == ids
    assert not seen


@pytest.mark.parametrize("seed,open_windows", [(1, 8192), (2, 5), (3, 8192)])
def test_every_id_once(seed, open_windows):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 63, 64, 65, 40, 200, rng.randint(1, 300)]) for _ in range(500)]
    documents = {i: ids_of(range(i, i + n)) for i, n in enumerate(sizes)}
    windows = list(packing.pack_documents(iter(documents.items()), 64, open_windows))
    check_windows(documents, windows, 64)


def test_one_size_that_never_fits_twice():
    documents = {i: ids_of([i] * 40) for i in range(100)}
    windows = list(packing.pack_documents(iter(documents.items()), 64, 8))
    check_windows(documents, windows, 64)
    assert sum(len(p[2]) // 4 for w in windows for p in w) == 4000


def test_level_is_the_one_with_least_squares():
    rng = random.Random(5)
    levels = packing.LevelArray(32)
    counts = [0] * 33
    for _ in range(300):
        size = rng.randint(1, 31)
        best = []
        for h in range(0, 33 - size):
            if h and not counts[h]:
                continue
            after = counts[:]
            if h:
                after[h] -= 1
            if h + size < 32:
                after[h + size] += 1
            best.append((sum(c * c for c in after[1:32]), -h))
        least, h = min(best)
        levels.place((0, 0, ids_of([0] * size), size), size)
        if h:
            counts[-h] -= 1
        if -h + size < 32:
            counts[-h + size] += 1
        assert [len(x) for x in levels.open] == [0, *counts[1:32]]


def test_no_documents():
    assert list(packing.pack_documents(iter([]))) == []


TEXTS = [None, "", " ", "a", "a<|endoftext|> b", "two  spaces \n\n x", "tab\tand\x0bmore", "é́ ü b 漢字 Ωmega", "word " * 3000, "x" * 5000]


def test_same_ids_as_the_tokenizer():
    from tokenizers import Tokenizer

    paths = vocabulary()
    plain = Tokenizer.from_file(paths[0])
    encode = encoder(*paths, True).encode
    for _ in range(2):
        for text in TEXTS:
            assert list(np.frombuffer(encode(text or ""), "<u4")) == plain.encode(text or "", add_special_tokens=False).ids
    plain.encode_special_tokens = True
    encode = encoder(*paths, False).encode
    for text in TEXTS:
        assert list(np.frombuffer(encode(text or ""), "<u4")) == plain.encode(text or "", add_special_tokens=False).ids


def test_pack_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, "x", -1, 0) for i, t in enumerate(TEXTS)] + [(3, "a", "x", -1, 0), (None, "b", None, None, None)],
        "doc_id long, text string, source string, start long, `offset` int",
    ).repartition(2)
    rows = packing.pack(docs, 128).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary()[0])
    wanted = sorted(tuple(plain.encode(r.text or "", add_special_tokens=False).ids) + (0,) for r in docs.collect())
    fills = {}
    for r in rows:
        assert r.length * 4 == len(r.ids)
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fills.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 128 or at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(map(len, wanted))
    whole = {}
    for r in sorted((r for r in rows if r.doc_id not in (3, None)), key=lambda r: (r.doc_id, r.start)):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    for i, text in enumerate(TEXTS):
        if i != 3:
            assert list(np.frombuffer(whole[i], "<u4")) == plain.encode(text or "", add_special_tokens=False).ids + [0]
    assert packing.pack(docs.limit(0)).collect() == []


def test_query_digest(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    row = packing.pack(docs).select("ids", F.crc32("ids").alias("crc")).orderBy("start").first()
    assert row.crc == zlib.crc32(bytes(row.ids))


def test_same_ids_on_odd_texts():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    signs = list("ab Z9 .,\n\t") + ["é", "ß", "ɏ", "ɐ", "Ω", "你", "\u0301", "\u00a0", "\u2019", "\x1c", "\x85", "\u200b", "²", "'s", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(3000)] + ["a" * 200_000, "é" * 50_000, "你" * 5000]
    paths = vocabulary()
    for special in (True, False):
        plain = Tokenizer.from_file(paths[0])
        plain.encode_special_tokens = not special
        encode = encoder(*paths, special).encode
        for text in texts:
            assert list(np.frombuffer(encode(text), "<u4")) == plain.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_long_runs_take_linear_time():
    import time

    encode = encoder(*vocabulary(), False).encode
    start = time.perf_counter()
    encode("a" * 1_000_000)
    assert time.perf_counter() - start < 20
