"""How many Python workers a task needs, and what they keep: both stay in an executor's memory for all stages that follow."""

import re
import tracemalloc

import numpy as np
from samples import words

from fundtrace.llm import decontaminate, packing, store, substring, text


def workers_of_tasks(df) -> list[int]:
    """For each Python node of the plan that ran, the Python nodes of its tasks at and below it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = [(re.search(r"\w", x).start(), x) for x in plan.split("\n") if re.search(r"\w", x)]
    out = []
    for i, (depth, line) in enumerate(lines):
        if "MapInArrow" not in line:
            continue
        n, below = 1, None
        for d, x in lines[i + 1 :]:
            if d <= depth:
                break
            if below is not None and d > below:
                continue
            below = d if re.search(r"\bExchange|BroadcastExchange|QueryStage", x) else None
            n += "MapInArrow" in x
        out.append(n)
    return out


def test_a_task_has_one_python_worker(spark, documents):
    passage = words(1, 60, 10**6)
    docs = documents([f"{words(2, 80, 10**6)} {passage}", f"{words(3, 80, 10**6)} {passage}", words(4, 90, 10**6)])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for limit in (10**6, 3):
        found = workers_of_tasks(decontaminate.decontaminate(docs, bench, limit))
        assert found and set(found) == {1}
    found = workers_of_tasks(substring.dedup(docs))
    assert len(found) == 3 and set(found) == {1}


def test_a_worker_keeps_nothing_of_other_operators():
    kept = packing.UnitIds.kept
    kept["a tokenizer"] = object()
    own = lambda batches: batches
    own.__module__ = packing.__name__
    assert list(store.thrifty(own)([1])) == [1] and kept
    assert list(store.thrifty(lambda batches: batches)([1])) == [1] and not kept


def test_hashes_of_words_take_little_memory_and_follow_the_word_alone():
    rows = [words(k, 3000, 10**6) for k in range(40)] + ["a" * 200_000, "b"]
    buf = np.frombuffer(" ".join(rows).encode(), np.uint8)
    first, last, _ = text.word_spans(buf, np.array([0]), np.array([len(buf)]))
    tracemalloc.start()
    got = text.word_hashes(buf, first, last)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(buf) > 900_000 and peak < 8 * len(buf)
    for i in [*range(0, len(first), 997), len(first) - 2, len(first) - 1]:
        one = buf[first[i] : last[i]]
        assert text.word_hashes(one, np.array([0]), np.array([len(one)]))[0] == got[i]
    assert len(text.word_hashes(buf[:0], first[:0], last[:0])) == 0
