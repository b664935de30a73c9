import pytest

from veritab.llm.common import documents

SMALL = "/root/testdata/sf0.001"
LONG = ("lorem ipsum dolor sit amet " * 40_000).strip()  # 200,000 words, one passage over and over
CLASHING = ["_words", "_text", "length", "piece", "votes", "at", "value", "label", "kept", "same", "sketch", "p", "media", "n", "rep", "a", "b", "_kept", "_id", "_copies", "_own_0", "record", "spans"]


def odd_rows():
    text = "The quick brown fox jumps over the lazy dog near the river bank and then it sleeps for a while in the sun until the evening comes."
    return [
        (1, text, "en"), (2, text, "en"), (2, text, "en"), (3, text.upper(), "en"), (4, "", "en"), (5, None, "en"), (6, " \t\n ", None), (7, LONG, "la"), (8, text, None), (None, text, "en"), (None, None, None),
        (9, "one two", "en"), (10, "éé ñ 漢字 ​ \x85 <|endoftext|> 😀", "xx"), (11, "a" * 50_000, "en"), (12, "1234567890 " * 50, "en"), (13, "mail x.y@z.org or +1 (259) 555-5738, ip 10.0.0.1, card 4111 1111 1111 1111 now", "en"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, "src", 0, *[f"x{k}" for k in range(len(CLASHING))]) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return documents(spark, SMALL)


@pytest.fixture(scope="session")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
