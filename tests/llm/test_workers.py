"""What the executors' Python workers hold, during a stage and after it."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

from tideline.llm import textops
from tideline.llm.store import stored

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: MB that the largest worker of a new session holds after two stages over 24 MB of texts.
STAGES = """
import random, re, sys, psutil
from pyspark.sql import SparkSession, functions as F
from tideline.llm import ngram_join, toxicity
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).getOrCreate()
r = random.Random(5)
words = [f"w{k}" for k in range(20000)]
rows = [(k, " ".join(r.choices(words, k=450))) for k in range(9000)]
docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
n = toxicity.without_toxic(docs, labels).count(), ngram_join.one_of_each_class(docs).count()
held = [0]
for p in psutil.Process().children(recursive=True):
    if p.status() != psutil.STATUS_ZOMBIE and "pyspark.daemon" in " ".join(p.cmdline()):
        held.append(sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open(f"/proc/{p.pid}/smaps_rollup").read()))) // 1024)
print("HELD", *sorted(held), "ROWS", *n)
spark.stop()
"""


def test_workers_give_back_what_a_stage_freed(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]), "OMP_NUM_THREADS": "1"}
    said = subprocess.run([sys.executable, "-c", STAGES, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "HELD" in said.stdout, said.stderr[-2000:]
    held = [int(x) for x in said.stdout.split("HELD")[1].split("ROWS")[0].split()]
    assert 40 < held[-1] < 110, held


def test_batches_on_their_way_to_workers_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    rows = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 5000) as text")
    got = stored(rows.mapInArrow(sizes, "size long, n long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 6000
    assert max(r["size"] for r in got) < 10 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(8 << 20)  # as it was


def test_a_long_document_leaves_no_table_of_its_length():
    r = np.random.default_rng(3)
    long = " ".join(f"w{k}" for k in r.integers(0, 1000, 500_000))
    texts = ["a b c", long, "w1 w2", long[: textops.CHUNK_BYTES]]
    parts = [textops.words(data, offsets) for _, data, offsets in textops.chunks(pa.array(texts))]
    assert sum(len(w) for w, _ in parts) == sum(len(t.split()) for t in texts)
    alone = {x: textops.words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0][0] for x in ("a", "w1", "w2", "w999")}
    all_words = np.concatenate([w for w, _ in parts])
    for x, h in alone.items():
        assert (all_words == h).sum() == sum(t.split().count(x) for t in texts)
    textops._powers.cache_clear()
    textops.words(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    assert textops._powers.cache_info().currsize == 0
