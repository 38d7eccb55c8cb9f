"""Very long texts full of matches: results by plain loops, and time that does not grow with their square."""

import re
import time

import pytest
from pyspark.sql import functions as F

from mailgrain.llm import decontamination, secrets


def timed(frame):
    began = time.time()
    return frame.collect(), time.time() - began


@pytest.mark.parametrize("lengths", [[3], [1, 2, 3], list(range(127)), list(range(128)), list(range(129)), [7] * 1000])
def test_running_ends(spark, lengths):
    got = spark.createDataFrame([(lengths,)], "x array<int>").select(secrets._running_ends(F.col("x")).alias("e")).collect()[0].e
    assert got == [sum(lengths[:i + 1]) for i in range(len(lengths))]


def test_spans_of_a_text_full_of_hex_runs(spark):
    text = " ".join(f"{i * 2654435761 % 2**32:08x}" * 3 for i in range(20_000))
    frame = spark.createDataFrame([(text,)], "t string").select(F.size(secrets.base_spans(F.col("t"))).alias("n"), secrets.listed(secrets.base_spans(F.col("t"))).alias("l"))
    rows, took = timed(frame)
    want = [f"hex:{m.start()}:{m.end()}" for m in re.finditer(secrets.HEX, text)]
    assert rows[0].n == len(want) and rows[0].l == ",".join(want)
    assert took < 60


def test_a_text_that_is_all_contaminated(spark):
    words = [f"w{i * 7919 % 50_021}" for i in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "quite other words " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(words)), ("b", "short one")], "item_id string, text string")
    rows, took = timed(decontamination.contamination(docs, items).orderBy("doc_id"))
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == [(40_000, 40_000, ["a"]), (60, 0, [])]
    assert took < 60
