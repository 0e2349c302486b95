"""Spelling variants: frequent words one edit apart, found on a trie whose edges are a distributed table.

A node is a prefix of some word, a row of ``nodes`` with the letters that lead on from it and from there. A
state is a word, the node reached and the edits made (0 or 1) after so many of its letters;
level after level one join with the nodes moves all states on by one letter:

- without an edit: along the own letter, or along a greater one (a replaced letter), or not at all (a deleted one);
- after the edit: along the own letter only, so most states end within two or three levels.

A state that has used up its letters after one edit, on a node that is a word itself, tells a pair of
near words. Each pair is met once: of two equal letters in a row the first is deleted, insertions are the deletions
of the other word, and replacements go to the greater letter. A node with one word below
ends the states without an edit, so shared prefixes only cost levels.

Words of more than ``LEVELS`` letters would need as many levels. Two of them that are near share their first
or their last half, so they are joined by halves and compared.

Words are distinct; null ones are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut, shuffle_width

LEVELS = 48
#: Levels with at most this many nodes are broadcast; they are counted before.
FEW_NODES = 20_000
#: So many levels with broadcast nodes are one job.
TOGETHER = 4
#: ``edits`` of a pair that is found.
FOUND = 2


def one_edit(a: Column, b: Column) -> Column:
    """Whether two strings differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def trie(words: DataFrame, levels: int) -> DataFrame:
    """``node, depth, leads, below, is_word``: prefixes of ``word`` of up to ``levels`` letters.

    ``leads`` has each letter that leads on, and the letters that lead on from there as one string.
    """
    size = F.char_length("word")
    prefixes = words.select("word", F.explode(F.sequence(F.lit(0), F.least(size, F.lit(levels)))).alias("depth"))
    ahead = F.substring("word", F.col("depth") + 1, F.lit(1))
    nodes = (
        prefixes.select(F.substring("word", F.lit(1), F.col("depth")).alias("node"), "depth", ahead.alias("letter"))
        # counted by letter first: a node near the root has a row a letter, not a row a word
        .groupBy("depth", "node", "letter")
        .agg(F.count(F.lit(1)).alias("below"))
        .groupBy("depth", "node")
        .agg(
            F.array_join(F.array_sort(F.collect_set("letter")), "").alias("letters"),
            F.sum("below").alias("below"),
            F.bool_or(F.col("letter") == "").alias("is_word"),
        )
    )
    up = F.substring("node", F.lit(1), F.col("depth") - 1).alias("node")
    leads = (
        nodes.filter("depth > 0")
        .select((F.col("depth") - 1).alias("depth"), up, F.struct(F.right("node", F.lit(1)).alias("letter"), "letters").alias("lead"))
        .groupBy("depth", "node")
        .agg(F.collect_list("lead").alias("leads"))
    )
    none = F.array().cast("array<struct<letter: string, letters: string>>")
    return nodes.join(leads, ["depth", "node"], "left").select("node", "depth", F.coalesce("leads", none).alias("leads"), "below", "is_word")


def _step(reached: DataFrame, level: int) -> DataFrame:
    """States after ``level + 1`` letters, from states joined with their nodes; found pairs are kept.

    A state after an edit is made only if the letter after next leads on, too.
    """
    letter, after = F.substring("word", level + 1, 1), F.substring("word", level + 2, 1)
    own = F.concat("node", letter)
    state = lambda node, depth, edits: F.struct(node.alias("node"), depth.cast("int").alias("depth"), F.lit(edits).alias("edits"))
    greater = F.filter("leads", lambda c: (c["letter"] > letter) & F.contains(c["letters"], after))
    replaced = F.transform(greater, lambda c: state(F.concat("node", c["letter"]), F.col("depth") + 1, 1))
    ended = F.char_length("word") == level
    first_of_run = F.lit(True) if level == 0 else letter != F.substring("word", level, 1)
    goes_on = F.exists("leads", lambda c: (c["letter"] == letter) & F.contains(c["letters"], after))
    # without the deleted letter the word goes on from the same node
    skips = F.exists("leads", lambda c: c["letter"] == after) | ((after == "") & F.col("is_word"))
    none = F.array().cast("array<struct<node: string, depth: int, edits: int>>")
    deleted = F.when(first_of_run & skips, F.array(state(F.col("node"), F.col("depth"), 1))).otherwise(none)
    untouched = F.concat(F.array(state(own, F.col("depth") + 1, 0)), replaced, deleted)
    to = (
        F.when((F.col("edits") == FOUND) | ended & F.col("is_word") & (F.col("edits") == 1), F.array(state(F.col("node"), F.col("depth"), FOUND)))
        .when(ended, none)
        .when(F.col("edits") == 0, F.when(F.col("below") > 1, untouched))
        .when(goes_on, F.array(state(own, F.col("depth") + 1, 1)))
    )
    return reached.select("word", F.explode(to).alias("to")).select("word", "to.*")


def _by_trie(words: DataFrame, levels: int) -> list[DataFrame]:
    """Pairs of words of at most ``levels`` letters."""
    spark = words.sparkSession
    nodes = cut(
        trie(words, levels).repartitionByRange(shuffle_width(spark), "depth", "node").sortWithinPartitions("depth", "node"),
        "trie-nodes",
    )
    # one row a level
    sizes = {r["depth"]: r["count"] for r in nodes.groupBy("depth").count().collect()}
    states = words.select("word", F.lit("").alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("edits"))
    pairs, deepest = [], max(sizes, default=-1)
    for level in range(deepest + 1):
        here = nodes.filter(F.col("depth").isin(level - 1, level)).drop("depth")
        few = sizes[level] + sizes.get(level - 1, 0) <= FEW_NODES
        # found pairs meet no node any more
        states = _step(states.join(F.broadcast(here) if few else here, "node", "left"), level)
        if not few or level % TOGETHER == TOGETHER - 1 or level == deepest:
            states = cut(states, "trie-level")
            pairs.append(states.filter(F.col("edits") == FOUND).select(F.col("word").alias("a"), F.col("node").alias("b")))
            states = states.filter(F.col("edits") < FOUND)
    return pairs


def _by_halves(words: DataFrame, levels: int) -> DataFrame:
    """Pairs of words of at least ``levels`` letters: keys are the halves left by the shorter word's length."""
    size = F.char_length("word")
    half = lambda n: F.floor((n - 1) / 2).cast("int")
    keys = [
        F.struct(n.cast("int").alias("n"), F.lit(side).alias("side"), part.alias("part"))
        for n in (size, size - 1)
        for side, part in (("head", F.substring("word", F.lit(1), half(n))), ("tail", F.right("word", half(n))))
    ]
    keyed = words.filter(size >= levels).select("word", F.explode(F.array(*keys)).alias("key"))
    # near words of lengths n and n, or n and n + 1, have the shorter one's length as n
    a, b = (keyed.select(F.col("word").alias(x), "key") for x in "ab")
    close = F.col("a") < F.col("b")
    return a.join(b, "key").filter(close & one_edit(F.col("a"), F.col("b"))).select("a", "b").distinct()


def near_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``word, near`` for all pairs of distinct ``word`` one edit apart, each in both directions."""
    words = cut(words.select("word").filter("word IS NOT NULL").distinct(), "trie-words")
    # a pair with a short word has no word of more than one letter more
    found = _by_trie(words.filter(F.char_length("word") <= levels), levels)
    if words.filter(F.char_length("word") >= levels).limit(1).count():
        long = _by_halves(words, levels)
        # those of two words that the trie has, too, are its own
        found.append(long.filter(F.greatest(F.char_length("a"), F.char_length("b")) > levels))
    if not found:
        return words.select("word", F.col("word").alias("near")).limit(0)
    pairs = reduce(DataFrame.unionByName, found)
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select(
        F.col("p.a").alias("word"), F.col("p.b").alias("near")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of ``form``. Chains are followed by doubling; they have no rings."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(counts: DataFrame, ratio: int = 5, levels: int = LEVELS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each row of ``word, n``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order), if that is at
    least ``ratio`` times the word's own; ``root`` is the last form of the chain, or the word itself.
    """
    counts = cut(counts.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL"), "spelling-words")
    near = near_pairs(counts, levels).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    joined = counts.join(best, "word", "left").withColumn("enough", -F.col("best.less") >= ratio * F.col("n"))
    formed = cut(
        joined.select(
            "word",
            F.when(F.col("enough"), F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("enough"), -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
