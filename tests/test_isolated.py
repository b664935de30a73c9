"""Readers that hang, end their process or take all memory."""

import os
import time

import pytest

from veritab.sources import files
from veritab.sources.isolated import CallError, Isolated

GB = 1 << 30


def made():
    """A reader that is pickled by value: executors don't have this module."""
    many = 64 * GB

    def reader(path):
        if "hang" in path:
            time.sleep(600)
        if "exit" in path:
            os._exit(3)
        if "kill" in path:
            os.kill(os.getpid(), 9)
        if "memory" in path:
            return ["x" * (many)]
        if "value" in path:
            raise ValueError("not a document")
        if "type" in path:
            return {"no": "list"}
        if "print" in path:
            print("noise on standard output", flush=True)
        return [f"text of {path} that is long enough", str(os.getpid())]

    return reader


def test_each_call_has_a_result():
    with Isolated(made(), deadline=2, memory=2 * GB) as call:
        first, again = call("a"), call("print")
        assert first[0] == "text of a that is long enough" and first[1] == again[1] != str(os.getpid())  # one child for many calls
        for what, said in (("value", "not a document"), ("hang", "not done within 2 seconds"), ("exit", "ended with code 3"), ("kill", "signal 9"), ("memory", "out of memory")):
            began = time.monotonic()
            with pytest.raises(CallError, match=said):
                call(what)
            assert time.monotonic() - began < 10
            assert call("b")[0].startswith("text of b")
        assert call("b")[1] != first[1]
        pid = int(call("b")[1])
    with pytest.raises(ProcessLookupError):
        os.kill(pid, 0)


def test_large_arguments_and_results():
    with Isolated(lambda text: [text, text], memory=2 * GB) as call:
        text = "é" * 5_000_000
        assert call(text) == [text, text]


def test_other_documents_go_on(spark):
    names = ["a", "hang", "b", "exit", "c", "memory", "d", "value", "e", "type", "print"]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "path string, own int").coalesce(2)
    found = {r["path"]: r for r in files.with_text(df, made(), deadline=2).collect()}
    assert [n for n in names if found[n]["error"]] == ["hang", "exit", "memory", "value", "type"]
    assert "within 2 seconds" in found["hang"]["error"] and "code 3" in found["exit"]["error"] and "memory" in found["memory"]["error"] and found["value"]["error"] == "not a document" and "list of texts" in found["type"]["error"]
    assert found["a"]["raw"].startswith("[Page 1]\ntext of a") and found["hang"]["raw"] is None and found["c"]["own"] == 4

    def extract(raw):
        if "of b" in raw:
            time.sleep(600)
        return {"merchant": raw[9:15], "total": 5, "none": None}

    rows = {r["path"]: r for r in files.extracted(files.with_text(df, made(), deadline=2), extract, deadline=2).collect()}
    assert rows["a"]["fields"] == {"merchant": "text o", "total": "5", "none": None} and rows["b"]["fields"] is None and "within 2 seconds" in rows["b"]["extraction_error"]
    assert rows["hang"]["extraction_error"] == "not enough readable text" and rows["c"]["extraction_error"] is None
