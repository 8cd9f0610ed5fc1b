"""Spelling variants: a dictionary of trie-node pairs.

Every distinct prefix of a word is a node of the forward trie, every distinct suffix one of the reversed trie.
Nodes are numbered by a 64-bit hash of their path, so that tasks number them without a shared counter.
A word is cut at every position into (prefix node, suffix node); a cut that skips a letter joins the nodes on
both sides of it. Two words that differ in one letter share the pair that skips it. A word with
one letter more shares the pair that skips this letter with the plain cut of the shorter word. Of
equal neighbouring letters only the first is skipped there, so that each such pair of words is met once.
Words that meet are compared whole (`levenshtein` of one), so equal numbers of different nodes make no pair.

The members of one pair of nodes differ in one letter at one place: there are at most as many as
the alphabet has letters, and one word without it. No group grows with the data, so the few
of each are compared in one row, and what goes on is a count and the best neighbour of each word.

Words and their counts come from all texts. Null, empty and repeated texts and rows count as they are
(null and empty: no words; equal rows: each by itself; a null key: the name starts with the colon). Ties between
neighbours go to the smallest in code-point order. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright.llm.tables import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_TIMES = 10
SLIP = 31
CUT, SKIP, SKIP_AGAIN = 0, 1, 2  # SKIP_AGAIN: the letter before is the same


def slipped(key: Column, word: Column, every: int = SLIP) -> Column:
    """The word, or for one (key, word) in `every` the word without one letter chosen by their checksum."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = SLIP, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least `letters` letters that occur at least `least` times in all texts."""
    runs = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS + "{" + str(letters) + ",}"), F.lit(0))
    found = docs.select(F.col(key).alias("key"), F.explode(runs).alias("run")).select((slipped(F.col("key"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return found.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def node(side: str, path: Column) -> Column:
    return F.xxhash64(F.lit(side), path)


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, kind, word, n): every plain cut and every cut that skips a letter."""
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    prefix = F.substring(F.col("word"), F.lit(1), F.col("at"))
    rest = F.substring(F.col("word"), F.col("at") + 1, F.length("word"))
    again = (F.col("at") > 0) & (F.substring(F.col("word"), F.col("at"), F.lit(1)) == F.substring(F.col("word"), F.col("at") + 1, F.lit(1)))
    skip = F.struct(F.when(again, SKIP_AGAIN).otherwise(SKIP).alias("kind"), F.substring(F.col("word"), F.col("at") + 2, F.length("word")).alias("tail"))
    plain = F.struct(F.lit(CUT).alias("kind"), rest.alias("tail"))
    sides = F.when(F.col("at") < F.length("word"), F.array(plain, skip)).otherwise(F.array(plain))
    both = cuts.select("word", "n", node("prefix", prefix).alias("prefix"), F.explode(sides).alias("side"))
    return both.select("prefix", node("suffix", F.col("side.tail")).alias("suffix"), F.col("side.kind").cast("byte").alias("kind"), "word", "n")


def _near(a: Column, b: Column) -> Column:
    """Whether two members of one pair of nodes are neighbours: both skip a letter there, or one first skips what the other has not."""
    met = ((a["kind"] != CUT) & (b["kind"] != CUT)) | ((a["kind"] == SKIP) & (b["kind"] == CUT)) | ((a["kind"] == CUT) & (b["kind"] == SKIP))
    return (a["word"] != b["word"]) & met & (F.levenshtein(a["word"], b["word"], 1) == 1)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): number of near words, and the one of largest count (ties: the smallest) with its count."""
    members = node_pairs(words).groupBy("prefix", "suffix").agg(F.collect_list(F.struct((-F.col("n")).alias("m"), "word", "kind")).alias("members"))
    met = members.where((F.size("members") > 1) & F.exists("members", lambda x: x["kind"] != CUT)).select("members", F.explode("members").alias("own"))
    ranked = met.select(F.col("own.word").alias("word"), F.filter("members", lambda x: _near(F.col("own"), x)).alias("near")).where(F.size("near") > 0)
    top = F.array_min(F.transform("near", lambda x: F.struct(x["m"].alias("m"), x["word"].alias("word"))))
    found = ranked.select("word", F.size("near").cast("long").alias("k"), top.alias("top"))
    out = found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("top").alias("top"))
    return out.select("word", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of a (word, form) table that never runs in a circle: forms followed to the last one.

    Each round doubles the length of the steps; a form counts at least ten times its word, so a few rounds do.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = SLIP, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, times: int = FORM_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    The form of a word is its near word of largest count if that is at least `times` as frequent. `every=0`
    reads the texts as they are.
    """
    words = stored(counted_words(docs, key, text, every, letters, least))
    near = words.join(neighbours(words), "word", "left")
    has_form = F.col("best_n") >= times * F.col("n")
    known = stored(near.select("word", F.when(has_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best_n")).alias("form_n")))
    rooted = roots(known.where("form is not null"))
    return known.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
