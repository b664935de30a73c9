"""A Merkle manifest of a table: a tree for each language over its documents, and a tree over these.

H is the lower-case hexadecimal SHA-256 of inputs put one after another, digests as hexadecimal text. A document's
leaf is H of its fields, each `-` if null, else its length in bytes, a colon and the value. Eight nodes in a row
become their H, level by level, until one is left; the last run of a level may be shorter, even a single node.

Trees are built in buckets of 4,096 positions, aligned so that no run crosses two of them. A bucket's nodes go to
one task as Arrow, where DuckDB runs a level at a time: ordered string_agg by run, then sha256. What a bucket ends in
is a node of the next round, so each round has a 4,096th of the nodes of the one before, and a language of
a third of all documents is as many even buckets as it needs. Going down again, each bucket meets the siblings
of its root and gives each of its nodes the siblings from there to the root; those of documents are digested at once
and never written.

Positions come from `ranks.placed`: no task and no window sees all documents of a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.workers import importable
from veritab.llm.common import discard, documents, own_columns, stored
from veritab.operators.ranks import placed

FAN = 8
#: Levels of a bucket, which so has FAN ** LEVELS nodes at the lowest one.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A level's nodes with their run, its H, and what stands to the left and right of each in the run.
_RUNS = f"""
    with runs as (select pos // {FAN} as run, string_agg(h, '' order by pos) as g from level group by run)
    select pos, run, sha256(g) as up, substr(g, 1, 64 * (pos % {FAN})) as l, substr(g, 64 * (pos % {FAN}) + 65) as r
    from level join runs on pos // {FAN} = run"""


def leaf_of(fields: list[Column]) -> Column:
    """H of the fields: `-` for a null, else the length in bytes, a colon and the value."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[text(c.cast("string")) for c in fields]), 256)


def tampered(doc_id: Column) -> Column:
    """Whether 3 divides the CRC-32 of the decimal doc_id; not for nulls."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _height(n: int, most: int) -> int:
    """How many levels a bucket of a tree with n nodes has: all of them if it is one of several."""
    levels = 0
    while levels < most and FAN**levels < n:
        levels += 1
    return levels


def _climbed(con, nodes, levels: int) -> list:
    """A table for each step up from nodes (pos, h); what it ends in is left in `level`."""
    con.register("nodes", nodes)
    con.execute("create or replace temp table level as select pos, h from nodes")
    steps = []
    for _ in range(levels):
        steps.append(con.sql(_RUNS).to_arrow_table())
        con.register("step", steps[-1])
        con.execute("create or replace temp table level as select run as pos, any_value(up) as h from step group by run")
    return steps


def bucket_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, n, h) of the next round from (tree, pos, n, h): pos is a node's position from 0 and n how many the tree has."""

    size = FAN**levels

    def climb(table):
        import duckdb
        import pyarrow as pa

        tree, pos, n = (table.column(c)[0].as_py() for c in ("tree", "pos", "n"))
        with duckdb.connect(config={"threads": 1}) as con:
            _climbed(con, table, _height(n, levels))
            root = con.execute("select h from level").fetchall()
        assert len(root) == 1, "a bucket has one root"
        return pa.table({"tree": [tree], "pos": [pos // size], "n": [-(-n // size)], "h": [root[0][0]]}, schema=pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())]))

    return nodes.select("tree", "pos", "n", "h").groupBy("tree", F.floor(F.col("pos") / size).alias("bucket")).applyInArrow(climb, "tree long, pos long, n long, h string")


def rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of each round of (tree, pos, n, h), up to one where every tree has one node; all but the first are stored."""
    found = [nodes]
    while not found[-1].where("n > 1").isEmpty():
        found.append(stored(bucket_roots(found[-1], levels), "round"))
    return found


def _joined(nodes: DataFrame, above: DataFrame, levels: int, f, schema: str) -> DataFrame:
    """f of each bucket of nodes and the node above it, with its siblings (l, r: lists from below)."""
    bucket = lambda df, c: df.groupBy(F.col("tree").alias("_tree"), c.alias("_bucket"))
    return bucket(nodes, F.floor(F.col("pos") / FAN**levels)).cogroup(bucket(above, F.col("pos"))).applyInArrow(f, schema)


def siblings(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """nodes (tree, pos, n, h) with the siblings on their way to the root, from those of the next round (tree, pos, l, r)."""

    def descend(own, over):
        import duckdb
        import pyarrow as pa

        outer = {c: over.column(c)[0].as_py() for c in ("l", "r")}
        with duckdb.connect(config={"threads": 1}) as con:
            steps = _climbed(con, own, _height(own.column("n")[0].as_py(), levels))
            con.register("own", own)
            found = _paths(con, steps, "select tree, pos, n, h from own")
            names = [f"{side}{k}" for side in "lr" for k in range(len(steps))]
            rows = con.execute(f"select tree, pos, n, h{''.join(', ' + c for c in names)} from ({found})").fetchall()
        k = len(steps)
        return pa.table(
            [[x[i] for x in rows] for i in range(4)] + [[[*x[4 + s * k : 4 + (s + 1) * k], *outer[side]] for x in rows] for s, side in enumerate("lr")],
            schema=pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string()), ("l", pa.list_(pa.string())), ("r", pa.list_(pa.string()))]),
        )

    return _joined(nodes, above, levels, descend, "tree long, pos long, n long, h string, l array<string>, r array<string>")


def _paths(con, steps: list, nodes: str) -> str:
    """A query of nodes (pos, ...) with l0, r0, l1, ...: the siblings to the left and right at each step up."""
    query = nodes
    for k, step in enumerate(steps):
        con.register(f"step{k}", step)
        query = f"select x.*, s.l as l{k}, s.r as r{k} from ({query}) x join step{k} s on s.pos = x.pos // {FAN**k}"
    return query


def proved(leaves: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(doc_id, lang, leaf, subroot, proof_sha256, folded_root) of leaves (tree, pos, n, h, doc_id, lang, altered), from the next round's siblings and subroots.

    The fold begins with `altered` where there is one, else with the leaf.
    """

    def descend(own, over):
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            steps = _climbed(con, own, _height(own.column("n")[0].as_py(), levels))
            con.register("own", own)
            found = _paths(con, steps, "select doc_id, lang, pos, h, coalesce(altered, h) as f from own")
            left, right, subroot = (over.column(c)[0].as_py() for c in ("l", "r", "subroot"))
            pairs = [(f"l{k}", f"r{k}") for k in range(len(steps))] + [(f"'{a}'", f"'{b}'") for a, b in zip(left, right, strict=True)]  # digits alone
            for a, b in pairs:
                found = f"select * replace (sha256({a} || f || {b}) as f) from ({found})"
            proof = " || ".join(x for pair in pairs for x in pair) or "''"
            return con.sql(f"select doc_id, lang, h as leaf, '{subroot}' as subroot, sha256({proof}) as proof_sha256, f as folded_root from ({found})").to_arrow_table()

    return _joined(leaves, above, levels, descend, "doc_id long, lang string, leaf string, subroot string, proof_sha256 string, folded_root string")


def manifest(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    df: doc_id, source, lang, n_chars, text. A null is written as `-`, and null languages make a tree of their own, the
    first one. Documents of a language ascend by doc_id, nulls first; of several with one doc_id that with the smaller leaf
    comes first, and repeated rows are leaves of their own whose places are interchangeable. Texts are hashed whole. An empty table
    gives no rows (and has no root). Other columns are ignored. folded_root is what the proof gives for the document as it
    would be with its text lower-cased (A-Z) where `tampered` says so, else for the document as it is.
    """
    spark = df.sparkSession
    importable(spark)
    own = own_columns(df, *FIELDS)
    lower = F.translate("text", UPPER, UPPER.lower())
    altered = F.when(tampered(F.col("doc_id")), leaf_of([*[F.col(c) for c in FIELDS[:-1]], lower]))
    leaves = stored(own.select("doc_id", "lang", leaf_of([F.col(c) for c in FIELDS]).alias("h"), altered.alias("altered")), "leaves")  # hashed once, however often read
    langs = stored(placed(leaves.select("lang").distinct(), ["lang"], "tree"), "languages")
    rows = placed(leaves, ["doc_id", "h"], "pos", within=["lang"], size="n")
    trees = langs.select(F.col("lang").alias("_lang"), (F.col("tree") - 1).alias("tree"))
    rows = rows.join(trees, rows["lang"].eqNullSafe(trees["_lang"])).select("tree", (F.col("pos") - 1).alias("pos"), "n", "h", "doc_id", "lang", "altered")
    rows = stored(rows, "positions")
    discard(leaves)

    inner = rounds(rows, levels)
    subroots = inner[-1].select("tree", F.col("h").alias("subroot"))
    # the trees' roots are the leaves of one more tree, in which a tree's number is its position
    number = langs.count()
    outer = rounds(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(number).cast("long").alias("n"), F.col("subroot").alias("h")), levels)
    root = (outer[-1].select("h").first() or [None])[0]
    none = F.array().cast("array<string>")
    above = outer[-1].select("tree", "pos", "n", "h", none.alias("l"), none.alias("r"))
    for nodes in reversed(outer[:-1]):
        above = siblings(nodes, above, levels)
    above = above.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "l", "r")
    for nodes in reversed(inner[1:-1]):
        above = siblings(nodes, above, levels)
    above = stored(above.select("tree", "pos", "l", "r").join(subroots, "tree"), "siblings")  # a row for each bucket of documents
    found = proved(rows, above, levels)
    root = F.lit(root).cast("string")
    return found.select("doc_id", "lang", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_merkle_manifest(spark, sf_dir):
    return manifest(documents(spark, sf_dir)).drop("lang")
