import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kvspark.llm.packing import Packer, pack_documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def check(rows, ids_of):
    """Pieces cover each document once, sequences are gapless; sequence lengths."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, doc_tokens, sequence, offset, _ in rows:
        part = np.array(ids_of[doc_id][start : start + length], dtype="<u4")
        assert length > 0 and zlib.crc32(part.tobytes()) == crc and doc_tokens == len(ids_of[doc_id])
        pieces[doc_id].append((start, length))
        sequences[sequence].append((offset, length))
    for doc_id, ids in ids_of.items():
        at = 0
        for start, length in sorted(pieces[doc_id]):
            assert start == at
            at += length
        assert at == len(ids)
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    return sizes


def test_documents(spark, documents):
    rng = random.Random(1)
    words = ["the", "Word", "zßé", "idiot,", "0½", "x\n", "  y", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 300, 3000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 4000)]
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    ids_of = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    got = [tuple(r) for r in pack_documents(documents(rows), PATH, PATTERN).collect()]
    sizes = check(got, ids_of)
    assert all(s == 1024 or s & (s - 1) == 0 for s in sizes)  # no padding at all
    assert pack_documents(documents([]), PATH, PATTERN).count() == 0


def test_packer_at_many_sizes():
    rng = random.Random(2)
    for tiers in ((256, 512, 1024), (64, 1024), (1024,)):
        packer, ids_of = Packer(7 << 32, tiers=tiers), {}
        for d in range(400):
            n = rng.choice([1, 2, 255, 256, 257, 511, 1023, 1024, 1025, rng.randint(1, 5000)])
            ids_of[d] = [rng.randrange(50_000) for _ in range(n)]
            packer.add((d, n), np.array(ids_of[d], dtype="<u4").tobytes())
            if d % 50 == 49:
                packer.pack(4096)
        packer.finish()
        sizes = check(packer.rows, ids_of)
        assert all(s == 1024 or s & (s - 1) == 0 for s in sizes)
        assert sum(s < 256 for s in sizes) <= 8 or min(tiers) < 256


def test_steps_hold_the_same_over_partitions(spark, documents):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Word", "zßé"]) for _ in range(rng.choice([3, 30, 900])))) for i in range(200)]
    docs = documents(rows).repartition(7)
    got = pack_documents(docs, PATH, PATTERN, step=5000).collect()
    assert len({r["sequence_id"] >> 32 for r in got}) > 3
    steps, sequences = defaultdict(int), defaultdict(set)
    for r in got:
        steps[r["step_group"]] += r["length"]
        sequences[r["sequence_id"]].add(r["step_group"])
    assert all(len(s) == 1 for s in sequences.values()) and sorted(steps) == list(range(len(steps)))
    assert all(abs(n - 5000) <= 1024 for g, n in steps.items() if g < len(steps) - 1)
    # no more sequences than ids need, but for the powers of two at the partitions' ends
    assert len(sequences) <= sum(steps.values()) / 1024 + 7 * 10


def test_added_tokens_have_their_ids(spark, tmp_path):
    """The query and the pipeline's last stage, against the library with its default settings."""
    import corpus_pipeline
    from kvspark.llm import queries

    end = "<|endoftext|>"
    texts = [f"a{end}b", end, end * 3, f"{end} a", f"a  {end}  b c ", f"{end}\n{end}", "<|endoftext", f"x <|endof{end}text|> y", None, "no token"]
    rng = random.Random(3)
    texts += [" ".join(rng.choice(["the", f"a{end}", end, "zß", " \n", ""]) for _ in range(2000)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    ids_of = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert ids_of[0] == [64, 50256, 65, 0]
    for made in (queries.op6_tiered_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        check([tuple(r) for r in made.collect()], ids_of)
