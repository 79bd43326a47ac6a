"""Spelling variants: pairs of words one edit apart, by merging the subtrees of a trie.

A trie node is the prefix that leads to it.  By the counts of words below each
prefix, every inner node has one heavy child, the largest (ties: the smallest
character); edges to the others are light.  A word has at most log2(V) light
edges on its path, as each halves the words below.  At each inner node the
light subtrees are merged, with the character that leads into them replaced or
skipped, into each other and into the heavy one, which is never walked itself
(small to large).  Terminals of merged trees that coincide are words one edit
apart.  For a word w = p a s with the light edge a at p, whose heavy child is h:

* replaced, in the heavy subtree: w meets p h s;
* replaced, among the light ones: w meets all words with the same p and s;
* skipped: w meets p s, unless s begins with a (then the same pair comes up
  one node further on);
* the heavy edge skipped: w meets p h a s, and each word w meets w h.

So each pair comes up once.  No trie is held anywhere: the terminals of merged
trees are strings, and coincidence is a join of at most 3 log2(V) + 1 of them
for each word with the words themselves, or the grouping of (p, s).  Such a
group has one word for each letter at most, so it is bounded by the alphabet.

Null texts have no words.  Words are any strings without U+0000, empty ones
take no part; repeated rows of a word add up.  Counts are of all texts, and
nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm import shared

#: FIXED VALUES: letters that words are made of.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that a node's name spells out at most.
STEP = 64
#: Rounds of pointer doubling: counts rise by a factor at each form, so no chain has 2 ** ROUNDS of them.
ROUNDS = 7


def count_words(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, least_length: int = 6, least_n: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lower-cased, of so many letters and occurrences.

    ``change`` may turn a run into another by its id and itself before words are counted.
    """
    runs = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    words = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    word = change(F.col("doc_id"), F.col("run")) if change else F.col("run")
    return words.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


#: A word's path: the depth i of each node, its name k, and the next character ch ('' at the end).  A node's name is its
#: prefix, in which whole runs of STEP characters are replaced by the md5 of all up to there, so that long words stay short.
_PATH = f"""flatten(transform(
    transform(sequence(0, char_length(word) div {STEP}), b -> named_struct('b', b, 'd', if(b = 0, '', '\\0' || md5(left(word, {STEP} * b))), 't', substr(word, {STEP} * b + 1, {STEP}))),
    x -> transform(sequence(0, least({STEP - 1}, char_length(x.t))), j -> named_struct('i', {STEP} * x.b + j, 'k', x.d || left(x.t, j), 'ch', substr(x.t, j + 1, 1)))))"""


def _light(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n, p, a, s, heavy) of each light edge on a word's path, and (word, n, heavy) of words that are inner nodes."""
    named = words.withColumn("name", F.expr(f"if(char_length(word) < {STEP}, word, '\\0' || md5(word))"))
    nodes = shared.table(named.select("name", F.inline(F.expr(_PATH))), "nodes")
    below = nodes.where("ch <> ''").groupBy("k", "ch").agg(F.count(F.lit(1)).alias("n"))
    heavy = below.groupBy("k").agg(F.max(F.struct("n", (-F.ascii("ch")).alias("o"), "ch"))["ch"].alias("heavy"))
    # short prefixes are on the paths of most words
    turns = shared.attach(nodes, heavy, "k", "name").where("ch <> heavy").select("name", "i", "ch", "heavy").join(named, "name")
    turns = shared.table(turns.select("word", "n", "heavy", "ch", F.expr("left(word, i)").alias("p"), F.expr("substr(word, i + 2)").alias("s")), "turns")
    return turns.where("ch <> ''").withColumnRenamed("ch", "a"), turns.where("ch = ''").select("word", "n", "heavy")


def one_edit(words: DataFrame) -> DataFrame:
    """(word, n, x, m): each pair of the distinct ``words`` (word, n) one edit apart, once, with their counts."""
    light, inner = _light(words)
    met = light.select("word", "n", F.explode(F.array(
        F.concat("p", "heavy", "s"), F.when((F.col("s") == "") | (F.left("s", F.lit(1)) != F.col("a")), F.concat("p", "s")), F.concat("p", "heavy", "a", "s"),
    )).alias("x"))
    ends = inner.select("word", "n", F.concat("word", "heavy").alias("x"))
    found = met.where("x is not null").union(ends).join(words.select(F.col("word").alias("x"), F.col("n").alias("m")), "x").select("word", "n", "x", "m")
    # terminals that coincide among light subtrees: a word for each letter at most
    groups = light.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("g")).where("size(g) > 1")
    firsts = groups.select("g", F.posexplode("g").alias("i", "one"))
    pairs = firsts.select("one", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("other"))
    return found.union(pairs.select("one.word", "one.n", "other.word", "other.n"))


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    ``n_near``: words one edit apart.  ``form``: the one with the largest count
    (ties: the smallest) if that is at least ``times`` this word's; ``root``:
    the end of the chain of forms, the word itself without one.
    """
    words = shared.table(words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = one_edit(words)
    near = pairs.select("word", "x", "m").union(pairs.select("x", "word", "n"))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("k"), F.col("x"))).alias("b"))
    told = words.join(best, "word", "left").withColumn("up", (-F.col("b.k")) >= times * F.col("n"))
    out = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("up"), F.col("b.x")).alias("form"), F.when(F.col("up"), -F.col("b.k")).alias("form_n"))
    out = shared.table(out, "forms")
    return out.join(_roots(out), "word").select("word", "form", "root", "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): chains of forms followed to their ends, twice as far in each round."""
    at = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(ROUNDS):
        at = shared.table(at, "roots")
        step = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = at.select("root").distinct()
        if not ends.join(step, "root", "left_semi").limit(1).count():
            break
        # many words may have one root
        at = shared.attach(at, ends.join(step, "root", "left"), "root", "word").select("word", F.coalesce("next", "root").alias("root"))
    return at
