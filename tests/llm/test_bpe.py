import hashlib
import random

import public_tokenizers
import tiktoken

from kvspark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts(seed, n):
    rng = random.Random(seed)
    parts = [*"ab  \n\t'sé中0½²　\x1c\x85​́!?<|>", "  ", "'ll", " word", "the", "\xa0", "ß", "\r\n", "😀", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_same_ids_as_the_library():
    own = bpe.ByteBPE(RANKS, PATTERN, keep=500)
    for text in texts(1, 4000):
        ids = LIBRARY.encode_ordinary(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == text.encode()


def test_learned_together_as_one_by_one():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijké中n") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    words += ["".join(rng.choice("abe") * rng.randint(1, 9) for _ in range(12)) for _ in range(2000)]
    own = bpe.ByteBPE(RANKS, PATTERN)
    together = own.merge_many([w.encode() for w in words])
    assert together == [own.merge(w.encode()) for w in words]
    assert [list(t) for t in together] == [LIBRARY._encode_single_piece(w) for w in words]


def test_very_long_pre_tokens():
    rng = random.Random(3)
    own = bpe.ByteBPE(RANKS, PATTERN)
    for text in ("a" * 30_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "!" * 5000, " " * 3001 + "x"):
        assert own.encode(text) == LIBRARY.encode_ordinary(text)


def test_columns_and_digest(spark, documents):
    rows = [(i, t) for i, t in enumerate(texts(4, 200))] + [(None, "null id"), (5, None), (5, ""), (6, "x" * 9000)]
    docs = documents(rows)
    coded = bpe.bpe_encode(docs, "doc_id", "text", PATH, PATTERN)
    back = bpe.bpe_decode(coded, "key", "ids", PATH, PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_digest(docs, PATH, PATTERN).collect()), key=str) == sorted(want, key=str)
    assert bpe.bpe_digest(documents([]), PATH, PATTERN).count() == 0
