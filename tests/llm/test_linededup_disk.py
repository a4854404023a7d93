"""The line stage's disk: shuffles go with the table they made, nothing large is sorted, plans stay small."""

import os
import random

from pyspark.sql import functions as F
from test_linededup import check, mutate

from fieldnotes import scratch
from fieldnotes.llm import common, linededup


def shuffled(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(d, f)) for t in top for d, _, names in os.walk(str(t)) for f in names if f.startswith("shuffle"))


def test_a_written_table_leaves_no_shuffle(spark):
    before = shuffled(spark)
    rows = spark.range(200_000).groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("n"))
    assert scratch.cut(rows, "rows").count() == 200_000
    assert shuffled(spark) < before + 500_000
    assert spark.conf.get(scratch.CLEANUP, "false") == "false"
    assert rows.count() == rows.count() == 200_000


def test_planned_keys_are_the_keys_of_the_plan(spark):
    rng = random.Random(3)
    lines = spark.createDataFrame([(2 * i, "".join(rng.choice("abé ") for _ in range(rng.randrange(10, 40)))) for i in range(50)], "id long, line string")
    sized = lines.select("id", F.encode("line", "UTF-32").alias("wide"), F.length("line").alias("n"))
    want = sized.select("id", F.posexplode(F.array(*linededup.line_keys(F.col("wide"), F.col("n"), 2))).alias("at", "key"))
    got = linededup.planned_keys(sized, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_beyond_every_broadcast_lines_equal_brute_force(spark, monkeypatch):
    for module, name in ((linededup, "BROADCAST_ROWS"), (linededup, "BROADCAST_GONE"), (common, "BROADCAST_ROWS")):
        monkeypatch.setattr(module, name, 0)
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([9, 12, 20, 45]))) for _ in range(12)]
    docs = [(i, "\n".join(mutate(rng, rng.choice(base), rng.randrange(3)) for _ in range(rng.randrange(4)))) for i in range(40)]
    check(spark, docs + [(70, None), (None, base[0]), docs[3]])
    gone = linededup.hashed(spark.range(5), 0)
    plan = spark.range(9).join(gone, "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
