"""The store of answers: every prompt is called once, whatever is run again."""

import os

import pytest

from pressroll.operators.model import answered, read_answers
from pressroll.session import work_dir


@pytest.fixture
def calls(tmp_path):
    """A counting model: each call leaves a file; prompts that say so fail."""
    folder = str(tmp_path)

    def factory():
        def call(prompt):
            made = sum(name.startswith(prompt + "~") for name in os.listdir(folder))
            open(f"{folder}/{prompt}~{made}", "x").close()
            if prompt.startswith("bad") or prompt.startswith("once") and made == 0:
                raise ValueError(f"no answer {made}")
            return prompt.upper()
        return call

    def counts():
        found = {}
        for name in os.listdir(folder):
            found[name.split("~")[0]] = found.get(name.split("~")[0], 0) + 1
        return found

    return factory, counts


def _got(df):
    return {r["prompt"]: (r["response"], r["model_error"], r["attempt"]) for r in df.collect()}


def test_second_run_calls_nothing(spark, calls):
    factory, counts = calls
    store = work_dir(spark, "answers")
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "prompt string")
    for _ in range(2):
        out = answered(df, "prompt", factory, store)
        assert out.count() == 4 and _got(out) == {"a": ("A", None, 1), "b": ("B", None, 1), None: (None, "no prompt", None)}
        assert counts() == {"a": 1, "b": 1}


def test_failed_calls_are_repeated_and_counted(spark, calls):
    factory, counts = calls
    store = work_dir(spark, "answers")
    df = spark.createDataFrame([("once",), ("bad",), ("ok",)], "prompt string")
    assert _got(answered(df, "prompt", factory, store, attempts=2)) == {
        "once": ("ONCE", None, 2), "bad": (None, "ValueError: no answer 1", 2), "ok": ("OK", None, 1)}
    # the next run asks only what has no answer, and goes on counting
    again = answered(df, "prompt", factory, store, attempts=3)
    assert _got(again)["bad"] == (None, "ValueError: no answer 4", 5)
    assert counts() == {"once": 2, "bad": 5, "ok": 1}


def test_broken_off_run_goes_on(spark, calls):
    """Answers written before the break are used; only the rest is called."""
    factory, counts = calls
    store = work_dir(spark, "answers")
    df = spark.createDataFrame([(f"p{i}",) for i in range(20)], "prompt string")
    answered(df.where("prompt < 'p15'"), "prompt", factory, store).count()
    first = counts()
    out = answered(df, "prompt", factory, store, parallel=1, tasks=3)
    assert {p: r for p, (r, _, _) in _got(out).items()} == {f"p{i}": f"P{i}" for i in range(20)}
    assert set(counts().values()) == {1} and len(first) < 20
    assert read_answers(spark, store).count() == 20
