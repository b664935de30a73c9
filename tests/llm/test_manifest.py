"""The Merkle manifest against a tree built in one place."""

import hashlib
import random
import zlib

import pytest

from veritab.llm import manifest as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def climb(nodes):
    """(root, siblings to the left and right of each node, from below)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for n, p in enumerate(at):
            run, k = runs[p // 8], p % 8
            paths[n].append(("".join(run[:k]), "".join(run[k + 1 :])))
        at, nodes = [p // 8 for p in at], [h(*r) for r in runs]
    return nodes[0], paths


def plainly(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        of = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == lang), key=lambda x: x[:3])
        trees[lang] = (of, *climb([x[2] for x in of]))
    root, outer = climb([trees[lang][1] for lang in langs])
    out = []
    for lang, up in zip(langs, outer, strict=True):
        of, subroot, paths = trees[lang]
        for (_, _, own, r), path in zip(of, paths, strict=True):
            path = path + up
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                node = h(a, node, b)
            out.append((r[0], own, subroot, root, h(*[x for pair in path for x in pair]), node, node == root))
    return sorted(out, key=str)


def found_of(df, levels=M.LEVELS):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in M.manifest(df, levels).collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def random_rows(seed, n, langs):
    draw = random.Random(seed)
    maybe = lambda v: None if draw.random() < 0.1 else v
    return [(k * 3 - 50, maybe(draw.choice("abc")), draw.choice(langs), maybe(draw.randrange(100)), maybe("Ünicode Ä 漢 TEXT " * draw.randrange(3))) for k in range(n)]


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 600])
def test_like_one_tree(spark, n):
    rows = random_rows(n, n, ["en", "de", None, "é", "z"])
    assert found_of(spark.createDataFrame(rows, SCHEMA)) == plainly(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_trees_of_several_buckets(spark, levels):
    rows = random_rows(levels, 700, ["hot"] * 60 + [None, "", "one"] + [f"l{k}" for k in range(20)])
    assert found_of(spark.createDataFrame(rows, SCHEMA), levels) == plainly(rows)


def test_odd_tables(odd, empty):
    rows = [tuple(r[c] for c in M.FIELDS) for r in odd.collect()]
    assert found_of(odd) == plainly(rows)
    assert M.manifest(empty).collect() == []


def test_a_change_is_found(spark):
    rows = random_rows(1, 100, ["a", "b"])
    found = {r[0]: r for r in found_of(spark.createDataFrame(rows, SCHEMA))}
    changed = [(*rows[0][:4], "another text"), *rows[1:]]
    other = {r[0]: r for r in found_of(spark.createDataFrame(changed, SCHEMA))}
    assert {r[3] for r in found.values()} != {r[3] for r in other.values()}
    upper = {r[0] for r in rows if r[4] and r[4] != "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])}
    assert {k for k, r in found.items() if not r[6]} == {k for k in upper if zlib.crc32(str(k).encode()) % 3 == 0}
