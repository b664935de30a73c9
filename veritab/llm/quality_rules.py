"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gives two histograms: its characters over a few classes, and its words over the
commonest short words of the languages in the corpus, which are learned from it (all other words
share one bin). The histograms of all documents of a language, summed, are that language's
references. The Jensen-Shannon distance (base 2, so 0 to 1) of a document to the nearest reference
says how unlike natural text of any known language it is. Short documents have noisy histograms, so
a distance counts only from a minimum length on. How far words may be is measured by what a text
without a single common word would have.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.common import documents, own_columns, stored, text_or_empty, words

#: Character classes beside white space and all the rest, as regular expression sets.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "point": ".,;:!?'\"()-", "symbol": "#*$%&|<>"}
#: So many of a language's commonest words that are no longer than this, as they are written, are its common words.
COMMON_WORDS = 12
COMMON_LETTERS = 5
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The verdict of the method: a character distance above this is rejected, from the given length on.
MAX_CHAR_DISTANCE = 0.3
GUARD_CHARS = 400
#: A word distance of at least this share of what a text without common words has is rejected, from the given length on.
BARE_SHARE = 0.97
GUARD_WORDS = 50
#: A language has common words enough if natural text of GUARD_WORDS words lacks them all with no more than this chance.
LACKS_ALL = 0.01


def _only(text: Column, chars: str) -> Column:
    """How many characters are in the set."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: windows is an array of (hash, place), sorted."""
    def twice(x, k):
        same = lambda other: F.coalesce(F.get(windows, other)["h"] == x["h"], F.lit(False))
        return same(k - 1) | same(k + 1)

    return F.transform(F.filter(windows, twice), lambda x: x["i"])


def common_words(df: DataFrame) -> list[str]:
    """The COMMON_WORDS commonest short words of every language of df (text, lang), sorted; of equal ones the first in the alphabet.

    Words are counted before they are shuffled, and only each partition's commonest ones of a language meet.
    """
    each = df.where(F.col("lang").isNotNull()).select("lang", F.explode(words(text_or_empty())).alias("w")).where(F.length("w") <= COMMON_LETTERS)
    n = each.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("k") <= COMMON_WORDS)
    return sorted({r["w"] for r in top.select("w").collect()})


def histograms(df: DataFrame, keep: list[str], common: list[str]) -> DataFrame:
    """The base counts and histograms of every whole text, beside the columns to keep.

    char_counts is by class; found has the common words that occur, each with its count.
    """
    text = text_or_empty()
    ws = F.col("_words")
    rows = df.select(*[df[c] for c in keep], text.alias("_text")).withColumn("_words", words(F.col("_text")))
    rows = rows.select(
        *keep, "_text",
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.transform(ws, lambda w: F.xxhash64(w)).alias("_hashes"),
        F.filter(ws, lambda w: w.isin(common) if common else F.lit(False)).alias("_found"),
        F.filter(F.split(F.col("_text"), "\n", -1), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("_lines"),
    )
    h = F.col("_hashes")
    rows = rows.select(
        *keep, "_text", "n_words", "word_chars", "_found",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))).alias("_windows"),
    )
    w = F.col("_windows")
    rows = rows.select(
        *keep, "_text", "n_words", "word_chars", "_found", "n_dup_lines",
        F.when(F.size(w) > F.size(F.array_distinct(w)), F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_windows"),
    )
    rows = rows.withColumn("_places", F.sort_array(F.when(F.col("_windows").isNotNull(), _repeat_words(F.col("_windows")))))
    p, t, found = F.col("_places"), F.col("_text"), F.col("_found")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x)), F.lit(0), lambda a, x: a + x)
    rows = rows.select(
        *keep, "n_words", "word_chars", "n_dup_lines",
        F.transform(F.array_distinct(found), lambda x: F.struct(x.alias("w"), F.size(F.filter(found, lambda y: y == x)).cast("long").alias("n"))).alias("found"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(t).cast("long").alias("n_chars"),
        *[_only(t, chars).alias(f"_{name}") for name, chars in CLASSES.items()],
    )
    classes = [F.col(f"_{name}") for name in CLASSES] + [F.col("n_chars") - F.col("word_chars")]
    return rows.select(*keep, "n_words", "word_chars", F.col("_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "n_chars", F.array(*classes, F.col("n_chars") - sum(classes[1:], classes[0])).alias("char_counts"), "found")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _sound(rows: DataFrame) -> DataFrame:
    return rows.where(~base_failed() & F.col("lang").isNotNull())


def char_references(rows: DataFrame) -> dict[str, list[float]]:
    """By language, the histogram of characters over all its documents that pass the base rules, as shares.

    rows has lang, n_words and the counts. A short row for each language comes to the driver.
    """
    n = len(CLASSES) + 2
    found = _sound(rows).groupBy("lang").agg(*[F.sum(F.col("char_counts")[k]).alias(f"b{k}") for k in range(n)]).orderBy("lang").collect()
    return {r["lang"]: [r[f"b{k}"] / total for k in range(n)] for r in found if (total := sum(r[f"b{k}"] for k in range(n)))}


def word_references(rows: DataFrame, common: list[str]) -> dict[str, dict[str, float]]:
    """The same for words: by language, the share of each common word; what they lack of 1 are all other words.

    A row for each language and common word comes to the driver.
    """
    sound = _sound(rows)
    total = {r["lang"]: r["n"] for r in sound.groupBy("lang").agg(F.sum("n_words").alias("n")).collect()}
    each = sound.select("lang", F.inline("found")).groupBy("lang", "w").agg(F.sum("n").alias("n")).collect()
    found: dict[str, dict[str, float]] = {lang: {} for lang in sorted(total)}
    for r in each:
        found[r["lang"]][r["w"]] = r["n"] / total[r["lang"]]
    return found


def _term(p: Column, q: Column) -> Column:
    """What a bin adds to twice the divergence, less what it would add if it were empty in the document."""
    half = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / half) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0) - q).otherwise(0.0)


def nearest(counts: Column, refs: list[list[float]]) -> Column:
    """The Jensen-Shannon distance of a histogram to the nearest of the references; null without any, or without counts."""
    if not refs:
        return F.lit(None).cast("double")
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.transform(counts, lambda x: x / F.nullif(total, F.lit(0)))
    every = F.from_json(F.lit(json.dumps(refs)), "array<array<double>>")
    twice = F.transform(every, lambda q: F.aggregate(F.zip_with(shares, q, _term), F.lit(1.0), lambda a, x: a + x))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.array_min(twice) / 2)))


def nearest_words(refs: list[dict[str, float]], common: list[str]) -> Column:
    """The same for words, of which only those found bear on a distance."""
    if not refs:
        return F.lit(None).cast("double")
    by_word = F.from_json(F.lit(json.dumps({w: [r.get(w, 0.0) for r in refs] for w in common})), "map<string,array<double>>")
    others = F.from_json(F.lit(json.dumps([max(0.0, 1 - sum(r.values())) for r in refs])), "array<double>")
    n = F.nullif(F.col("n_words"), F.lit(0))
    rest = n - F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    bins = F.concat(F.transform("found", lambda x: F.struct((x["n"] / n).alias("p"), by_word[x["w"]].alias("q"))), F.array(F.struct((rest / n).alias("p"), others.alias("q"))))
    twice = F.transform(F.sequence(F.lit(0), F.lit(len(refs) - 1)), lambda r: F.aggregate(bins, F.lit(1.0), lambda a, x: a + _term(x["p"], F.get(x["q"], r))))
    return F.when(F.col("n_words") > 0, F.sqrt(F.greatest(F.lit(0.0), F.array_min(twice) / 2)))


def bare_distance(ref: dict[str, float]) -> float:
    """The distance of a word reference to a text without a single common word."""
    other = max(0.0, 1 - sum(ref.values()))
    half = (1 + other) / 2
    return math.sqrt(max(0.0, (1 - math.log2(half) + (other * math.log2(other / half) if other > 0 else 0.0) - other) / 2))


def telling(refs: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """The languages whose natural texts of GUARD_WORDS words hardly ever lack all common words."""
    return {lang: ref for lang, ref in refs.items() if max(0.0, 1 - sum(ref.values())) ** GUARD_WORDS <= LACKS_ALL}


def verdict(chars: dict[str, list[float]], refs: dict[str, dict[str, float]], common: list[str]) -> Column:
    """Whether a row of counts is kept.

    Words say nothing of languages that hardly use common ones: documents of these are held to characters
    alone, as are those without lang beside such languages.
    """
    far_chars = (F.col("n_chars") >= GUARD_CHARS) & (nearest(F.col("char_counts"), list(chars.values())) > MAX_CHAR_DISTANCE)
    known = telling(refs)
    others = [lang for lang in refs if lang not in known]
    far_words = F.lit(False)
    if known:
        far_words = (F.col("n_words") >= GUARD_WORDS) & (nearest_words(list(known.values()), common) >= BARE_SHARE * min(map(bare_distance, known.values())))
        if others:
            far_words = far_words & ~F.coalesce(F.col("lang").isin(others), F.lit(True))
    return ~base_failed() & ~F.coalesce(far_chars, F.lit(False)) & ~F.coalesce(far_words, F.lit(False))


def quality_rules(df: DataFrame) -> DataFrame:
    """doc_id, the base counts, js_chars, js_words, base_failed and kept for every document.

    A null or empty text has no words, so base_failed is true. A null lang takes no part in the references. Very
    long texts are judged whole. Repeated rows each give a row and count each in the references; an empty table
    gives none. Columns other than doc_id, text and lang are ignored.
    """
    own = own_columns(df, "doc_id", "text", "lang")
    common = common_words(own)
    rows = stored(histograms(own, ["doc_id", "lang"], common), "quality-rules")
    chars, refs = char_references(rows), word_references(rows, common)
    js_chars, js_words = nearest(F.col("char_counts"), list(chars.values())), nearest_words(list(refs.values()), common)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), js_chars.alias("js_chars"), js_words.alias("js_words"), verdict(chars, refs, common).alias("kept"))


def kept_documents(df: DataFrame) -> DataFrame:
    """The rows of df that the rules keep, each judged by its own text: nothing is joined, so repeated doc_ids do no harm.

    The texts are stored beside their counts, as the verdict needs the references of the whole corpus first.
    """
    names = {c: f"_own_{k}" for k, c in enumerate(df.columns)}
    own = df.select(*[df[c].alias(n) for c, n in names.items()], df["text"].alias("text"), df["lang"].alias("lang"))
    common = common_words(own)
    rows = stored(histograms(own, [*names.values(), "lang"], common), "quality-rules")
    return rows.where(verdict(char_references(rows), word_references(rows, common), common)).select(*[F.col(n).alias(c) for c, n in names.items()])


def op8_quality_rules(spark, sf_dir):
    # distances are left out here: two engines differ in their last digits
    return quality_rules(documents(spark, sf_dir)).drop("js_chars", "js_words")
