"""What fitting the quality model costs the driver."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa

from paperledger.llm import quality

MEMORY = """
import re, sys
from pathlib import Path
import numpy as np
from paperledger.llm import quality

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

rng = np.random.default_rng(3)
many = lambda: (np.unique(rng.integers(16, 1 << quality.BITS, 1000, dtype=np.int32)) for _ in range(3000))
y = np.arange(3000) % 2 * 2 - 1
quality.EPOCHS = 2
before = held()
rows = list(quality.stored(many()) if hasattr(quality, "stored") else many())
model = quality.fit_rows(rows, y, 0.5)
del rows
print(held() - before)
"""


def test_quality_leaves_no_memory_with_the_driver():
    """12 MB of features and 24 MB of values go back to the system; the model takes 4 MB."""
    run = subprocess.run([sys.executable, "-c", MEMORY], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert float(run.stdout) < 16, run.stdout + run.stderr


def test_quality_fits_in_few_jobs(spark):
    """Not a job for each partition of the shuffle."""
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text of number {i}") for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few-jobs", "fit")
    try:
        model = quality.fit(docs, marks)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 30
    assert (quality._scorer(model)(pa.array(["good text", "bad text"])) > 0.5).tolist() == [True, False]
