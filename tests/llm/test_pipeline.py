import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from kvspark.llm import packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, block string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=3, n=500):
    rng = random.Random(seed)
    syllables = ["an", "the", "er", "ing", "on", "ble", "sh", "ou", "re", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    docs, labels, what = [], [], {}
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 90))]
        kind = rng.choice(["clean"] * 5 + ["toxic", "low", "copy", "near", "passage"])
        if kind in ("copy", "near") and not any(k == "clean" for k in what.values()):
            kind = "clean"
        if kind == "toxic":
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumlo", "vexxa", "Zorqi"]) + rng.choice(["", "er"]))
        elif kind == "low":
            words = [w + rng.choice(["***", "%%%"]) for w in words]
        elif kind in ("copy", "near"):
            base = rng.choice([d for d in docs if what[d[0]] == "clean"])
            words = base[1].split()
            if kind == "near":
                words = [*words[:-1], "changed"]
        elif kind == "passage":
            words = words + passage
        docs.append((i, " ".join(words)))
        what[i] = kind
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return docs, labels, what


def test_stages(spark, tmp_path):
    docs, labels, what = corpus()
    rows = [(i, t, "en", "s", len(t), "x") for i, t in docs] + [(9000, None, None, None, None, None), (9001, "", "en", "s", 0, "x")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    kinds = lambda name: Counter(what.get(i, "edge") for i in seen[name])
    start = Counter(what.values())
    assert kinds("toxicity")["toxic"] <= 0.1 * start["toxic"]
    assert sum(kinds("toxicity")[k] for k in ("clean", "copy", "near", "passage")) >= 0.98 * sum(start[k] for k in ("clean", "copy", "near", "passage"))
    assert kinds("quality")["low"] <= 0.1 * start["low"] and kinds("quality")["edge"] >= 1
    assert kinds("near_copies")["copy"] == 0 and kinds("near_copies")["near"] == 0
    assert kinds("near_copies")["clean"] == kinds("quality")["clean"]
    holders = sorted(i for i in seen["repeats"] if what.get(i) == "passage")
    texts = {i: t for i, t in docs}
    end = texts[holders[0]].split()[-60:]
    assert seen["repeats"][holders[0]]["text"] == texts[holders[0]]
    for i in holders[1:]:
        kept, before = seen["repeats"][i]["text"].split(), texts[i].split()[:-60]
        assert texts[i].split()[-60:] == end
        assert kept == before[: len(kept)] and len(before) - len(kept) <= 3  # words before it may be the same, too
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    total = sum(len(ids.packed(r["text"] or "")) // 4 + 1 for r in seen["repeats"].values())
    pieces = now.collect()
    assert sum(r["length"] for r in pieces) == total
    one = next(r for r in pieces if r["doc_id"] == holders[0] and r["start"] == 0)
    own = np.frombuffer(ids.packed(texts[holders[0]]) + bytes(4), dtype="<u4")[: one["length"]]
    assert zlib.crc32(own.tobytes()) == one["ids_crc32"]


def test_run_is_the_stages(spark, tmp_path):
    docs, labels, _ = corpus(4, 120)
    spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in docs], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == packing.NAMES and out.count() > 0


WORKERS = """
import sys
sys.path.insert(0, sys.argv[1])
import corpus_pipeline
import psutil
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = corpus_pipeline.run(spark, sys.argv[2]).collect()
own = [p for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline())]
print(len(rows) > 0, len(own))
spark.stop()
"""


def test_a_core_has_one_python_worker(spark, tmp_path):
    """Workers stay, with the models that they hold: one core needs a daemon and one worker through all stages."""
    docs, labels, _ = corpus(4, 120)
    spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in docs], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    done = subprocess.run([sys.executable, "-c", WORKERS, root, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["True", "2"], done.stderr
