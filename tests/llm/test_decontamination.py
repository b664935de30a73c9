"""Benchmark decontamination against plain code."""

import hashlib
import random
import re

import pytest

from veritab.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plainly(docs, items, n=D.WINDOW):
    """(n_words, hit words, items) of each text, window by window."""
    windows = set()
    for item, text in items:
        w = WORD.findall(lower(text))
        k = min(n, len(w))
        windows |= {(item, tuple(w[i : i + k])) for i in range(len(w) - k + 1) if k}
    out = []
    for text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(item)
        out.append((len(w), hit, found))
    return out


def random_tables(seed):
    draw = random.Random(seed)
    letters = ["a", "B", "é", "1", "漢", "Z9", "c", "d"]
    gaps = [" ", "\n", "--", "\x00", "_", "\x7f", "  "]
    text = lambda n: "".join(draw.choice(letters) + draw.choice(gaps) for _ in range(n))
    items = [(k, text(draw.choice([0, 1, 2, 5, 10, 11, 14, 30]))) for k in range(12)] + [(3, text(12)), (None, text(10)), (5, None)]
    docs = [text(draw.choice([0, 1, 9, 10, 40])) for _ in range(25)] + [None]
    for k in range(20):
        docs.append(text(5) + items[k % 12][1] + text(7) + items[(k + 5) % 12][1].upper())
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 400])
def test_like_plain_code(spark, seed, block):
    docs, items = random_tables(seed)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in D.scanned(df, benchmark, block_bytes=block).collect()}
    assert len(found) == len(docs)
    for k, (n, hit, of) in enumerate(plainly(docs, items)):
        spans = [(s["start"], s["end"]) for s in found[k]["hits"]]
        assert found[k]["n_words"] == n
        assert {w for a, b in spans for w in range(a, b)} == hit
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        assert found[k]["items"] == sorted(i for i in of if i is not None)


def test_pieces_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    items = [(1, " ".join(f"w{k}" for k in range(60))), (2, "w1 w2 w3"), (3, " ".join(f"w{k}" for k in range(16)))]
    docs = [" ".join(f"w{k}" for k in range(a, a + 12)) for a in range(0, 49)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in D.scanned(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, (_, hit, of) in enumerate(plainly(docs, items)):
        assert sum(s["end"] - s["start"] for s in found[k]["hits"]) == len(hit) and found[k]["items"] == sorted(of)


def test_hash_collisions_are_verified(spark, monkeypatch):
    monkeypatch.setattr(D, "hashed", lambda columns, seed: (columns.astype("uint64").sum(axis=0) + seed) % (1 << 20))  # order is lost
    items = [(1, "a b c d e f g h i j"), (2, "k")]
    windows = D.Windows.of([(i, D.plain(t)) for i, t in items], 10)
    assert windows.scan(D.plain("j i h g f e d c b a"))[1:] == ([], [])
    assert windows.scan(D.plain("x a b c d e f g h i j k"))[1:] == ([(1, 12)], [1, 2])


def test_cut_spans():
    assert D.without_spans("Été: one, TWO three! four", [(1, 3)]) == "Été:  three! four"
    assert D.without_spans("one two", [(0, 2)]) == ""
    assert D.without_spans("a  b.", [(1, 2)]) == "a  ."
    assert D.without_spans(None, []) is None


def test_documents_and_spans_are_removed(odd, spark):
    items = spark.createDataFrame([(1, "JUMPS over the lazy dog near the river bank and"), (2, "two")], "item_id long, text string")
    rows = odd.collect()
    clean = D.decontaminated(odd, items).collect()
    dirty = [r for r in rows if r["text"] and re.search(r"lazy dog|\btwo\b", r["text"].lower())]
    assert len(clean) == len(rows) - len(dirty) and {r["doc_id"] for r in clean} == {4, 5, 6, 7, 10, 11, 12, 13, None}
    cut = D.decontaminated(odd, items, "spans")
    assert cut.columns == odd.columns
    texts = {r["doc_id"]: r for r in cut.collect() if r["doc_id"]}
    assert texts[9]["text"] == "one " and texts[9]["n_chars"] == 4 and texts[9]["length"] == "x2"
    assert "jumps" not in texts[1]["text"] and texts[1]["text"].startswith("The quick brown fox ")
    assert texts[5]["text"] is None and texts[7]["text"].startswith("lorem")


def test_odd_tables(odd, empty, spark):
    items = odd.select(odd["doc_id"].alias("item_id"), "text", "kept", "at", "hits" if "hits" in odd.columns else "spans")
    found = D.contamination(odd, items).collect()
    assert len(found) == odd.count()
    of = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert of[5]["n_words"] == 0 and not of[5]["contaminated"] and of[5]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert of[1]["items_sha256"] == hashlib.sha256(b"1,2,3,8").hexdigest() and of[1]["n_items"] == 4 and of[1]["n_hit"] == of[1]["n_words"]
    assert of[7]["n_words"] == 200_000 == of[7]["n_hit"]
    assert D.contamination(empty, items).collect() == []
    assert not any(r["contaminated"] for r in D.contamination(odd, items.where("false")).collect())
