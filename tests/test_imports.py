"""Imports of a growing folder."""

import hashlib
import os
import threading

import pytest

from veritab.sources import files, imports
from veritab.sources.store import Store


@pytest.fixture
def registry(spark, tmp_path):
    return imports.Registry(Store.at(tmp_path / "store", spark))


def put(folder, **contents):
    for name, content in contents.items():
        path = folder / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def by_name(registry, folder):
    return {r["path"].split(f"{folder}/")[1]: r for r in registry.documents().collect()}


def test_a_folder_that_grew(registry, tmp_path):
    folder = tmp_path / "in box"
    put(folder, b_pdf=b"one", sub__a_PNG=b"one", c_jpg=b"two", d_txt=b"no")
    first = registry.add(str(folder))
    assert (first["number"], first["added"], first["duplicates"], first["known"]) == (1, 2, 1, 0)
    put(folder, a_pdf=b"one", e_pdf=b"three", f_pdf=b"three", sub__g_heic=b"two")
    second = registry.add(str(folder))
    assert (second["number"], second["added"], second["duplicates"], second["known"]) == (2, 1, 3, 3)
    rows = by_name(registry, folder)
    assert len(rows) == 7 and len({r["id"] for r in rows.values()}) == 7
    original = lambda name: rows[name]["duplicate_of"]
    assert original("b.pdf") is None and original("sub/a.PNG") == rows["b.pdf"]["id"]
    assert original("a.pdf") == rows["b.pdf"]["id"]  # earlier by age, though not by path
    assert original("f.pdf") == rows["e.pdf"]["id"] and original("sub/g.heic") == rows["c.jpg"]["id"]
    assert rows["e.pdf"]["digest"] == hashlib.sha256(b"three").hexdigest()
    before = {r["path"]: r["id"] for r in rows.values()}
    put(folder, b_pdf=b"changed")
    third = registry.add(str(folder))
    assert (third["added"], third["duplicates"], third["known"]) == (0, 0, 7) and {r["path"]: r["id"] for r in registry.documents().collect()} == before


def test_links_large_and_unreadable_files(registry, tmp_path, monkeypatch):
    folder, other = tmp_path / "in", tmp_path / "other"
    put(folder, a_pdf=b"one", sub__b_pdf=b"two")
    put(other, c_pdf=b"three", d_pdf=b"four")
    os.symlink(other / "c.pdf", folder / "link.pdf")
    os.symlink(other, folder / "linked")
    put(folder, large_pdf=b"x" * (files.MAX_BYTES + 1))
    found = registry.add(str(folder))
    assert (found["added"], found["refused"]) == (2, 1)
    rows = by_name(registry, folder)
    assert set(rows) == {"a.pdf", "sub/b.pdf", "large.pdf"} and rows["large.pdf"]["status"] == "refused" and rows["large.pdf"]["digest"] is None and "more than" in rows["large.pdf"]["error"]
    assert registry.add(str(folder))["added"] == 0


def test_two_imports_at_once(spark, registry, tmp_path):
    folder = tmp_path / "in"
    put(folder, a_pdf=b"one", b_pdf=b"one", c_pdf=b"two")
    found = []
    threads = [threading.Thread(target=lambda: found.append(registry.add(str(folder)))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["number"] for r in found) == [1, 2, 3] and sum(r["added"] for r in found) == 2 and sum(r["duplicates"] for r in found) == 1
    assert registry.documents().count() == 3


def test_an_empty_folder_and_no_imports(registry, tmp_path):
    assert registry.documents().collect() == [] and registry.last() == 0
    (tmp_path / "none").mkdir()
    assert registry.add(str(tmp_path / "none"))["added"] == 0 and registry.documents().collect() == []
