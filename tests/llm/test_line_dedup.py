"""Line dedup against brute force."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup

SCHEMA = "doc_id long, text string"
TABLE = {c: c + 32 for c in range(65, 91)}


def key(line: str) -> str:
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate(TABLE)


def brute(docs: list[tuple]) -> list[tuple]:
    top = (1 << 63) - 1
    owner: dict = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            k = key(line)
            owner[k] = min(owner.get(k, top), top if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (top if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options) -> list[tuple]:
    return sorted((tuple(r) for r in line_dedup.dedup_lines(df, **options).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()), key=repr)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines_of_many_documents(spark, batches, fanout):
    draw = random.Random(batches)
    pool = [f"line number {i} of the pool" for i in range(60)] + ["short", "", "ÄRGER über Ärger", " Padded Line Here\t", "padded line here", "0123456789", "012345678"]
    docs = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 9)))) for i in range(120)]
    docs += [(i, "the same line everywhere\n" + t) for i, t in docs[:40]]
    assert found(spark.createDataFrame(docs, SCHEMA), batches=batches, fanout=fanout) == brute(docs)


def test_defined_cases(spark):
    docs = [(None, "one line of text\n"), (None, "one line of text\nanother line of text"), (5, None), (4, ""), (5, "ONE line of text\r\n\n\x0bone line of text"), (9, "\n".join(["ONE LINE OF TEXT"] * 3000)), (5, "another line of text"), (9, "another line of text\x1c"), (3, " one line of text")]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"doc": F.lit(1), "copy": F.lit("x"), "lines": F.lit(2), "places": F.lit(None).cast("string"), "h1": F.lit(0)})
    assert found(df) == brute(docs)
    assert found(df, batches=3) == brute(docs)
    assert found(df.limit(0)) == []


def test_runs_are_put_together(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    gone = 0
    for day in range(7):
        docs = spark.createDataFrame([(day * 10 + i, f"a line of day {day} and {i}\nold line number {j} again") for i in range(5) for j in range(day + 1)], SCHEMA)
        gone += runs.add(line_dedup.keyed_lines(docs)).count()
        assert all(len(level) <= 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    keys = [r for run in runs.runs() for r in run.collect()]
    assert len(keys) == len({(r.h1, r.h2) for r in keys}) == 7 * 5 + 7
    plan = runs.runs()[0].join(runs.runs()[1].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan
    assert gone > 0
    runs.discard()
    assert runs.runs() == []
