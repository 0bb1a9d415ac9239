"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and their usual form.

1. Distinct words are counted and numbered in the order (count downwards, word), so that the best of several words is the one
   with the smallest number.
2. A trie of the words and one of the reversed words have a node for every prefix and suffix. A node's number follows from
   its parent's and its letter, so no trie is ever in one place; a pass over all nodes proves that no number has two parents
   or letters, else another seed is taken. Equal numbers then are equal prefixes, and everything below is exact.
3. A word makes one integer pair (prefix node, suffix node) for each skipped position and one for each position where
   something may be inserted. Words that share a pair of skips differ in that place only; a word whose skip is another's
   insertion pair is longer than it by one letter. In a run of equal letters only the first counts as deleted, so every pair
   of neighbours meets in one pair of nodes. A pair of nodes has at most one word per letter of the alphabet (and one
   without): its groups are bounded by the alphabet, and only numbers are shuffled.
4. Forms lead to a word at least ``ratio`` times as frequent, so chains are as short as the logarithm of the largest count;
   the roots are found by doubling.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import mix64, over_batches, slices, stored, table

#: What lies between runs of letters, once A-Z are lower-cased.
BETWEEN = r"[^a-zÀ-ÿ]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Letters that one numpy pass works on, and rows of one batch that leaves it.
_PASS_LETTERS, _OUT_ROWS = 1 << 19, 1 << 18
# Roles of a word in a group: it skips a letter inside a run of equal letters, skips the first one of a run, inserts one.
_INSIDE, _FIRST, _WHOLE = 0, 1, 2


@dataclass(frozen=True)
class Spelling:
    """Words of at least ``letters`` code points found at least ``least`` times; a form is ``ratio`` times as frequent."""

    letters: int = 7
    least: int = 2
    ratio: int = 10


def word_counts(docs: DataFrame, how: Spelling = Spelling(), alter: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n) of the lower-cased runs of letters of ``docs`` (doc_id, text), each passed through ``alter(doc_id, run)``.

    An altered run may be shorter or longer than the run by one letter."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.split(lower, BETWEEN)).alias("run")).where(F.length("run") >= how.letters - 1)
    word = alter(F.col("doc_id"), F.col("run")) if alter else F.col("run")
    words = runs.select(word.alias("word")).where(F.length("word") >= how.letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= how.least)


def _chains(words: list[str], seed: int) -> tuple[np.ndarray, ...]:
    """Of words laid end to end: letters, start of each word's nodes, and numbers of the nodes of prefixes and suffixes.

    A word of n letters has n + 1 places; at place i stand its prefix of i letters and its suffix from letter i on."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    start = first + np.arange(len(words))
    front = np.empty(len(letters) + len(words), dtype=np.uint64)
    back = np.empty_like(front)
    roots = mix64(np.array([2 * seed + 1, 2 * seed + 2], dtype=np.uint64))
    by_size = np.argsort(-sizes, kind="stable")
    active = len(words)
    front[start], back[start + sizes] = roots[0], roots[1]
    at, end, last = start[by_size], (start + sizes)[by_size], (first + sizes)[by_size]
    begin, long = first[by_size], sizes[by_size]
    for depth in range(int(long[0]) if len(words) else 0):
        active = int(np.searchsorted(-long[:active], -depth, side="left"))
        a, b = at[:active] + depth, end[:active] - depth
        front[a + 1] = mix64(front[a] * _STEP + letters[begin[:active] + depth])
        back[b - 1] = mix64(back[b] * _STEP + letters[last[:active] - depth - 1])
    return letters, sizes, first, start, front, back


def _passes(batch: pa.RecordBatch):
    words = batch.column("word").to_pylist()
    for begin, end in slices(words, _PASS_LETTERS):
        yield begin, end, words[begin:end]


def _dictionary(seed: int):
    """The nodes of a batch: tree (0 of words, 1 of reversed words), number, parent's number, letter."""

    def run(batch: pa.RecordBatch):
        for _, _, words in _passes(batch):
            letters, sizes, first, start, front, back = _chains(words, seed)
            place = np.arange(len(letters)) + np.repeat(np.arange(len(words)), sizes)
            for tree, node, parent, root in ((0, front[place + 1], front[place], front[start[0]]),
                                             (1, back[place], back[place + 1], back[start[0] + sizes[0]])):
                node, parent = np.append(node, root), np.append(parent, np.uint64(0))
                letter = np.append(letters.astype(np.int64), -1)
                order = np.argsort(node, kind="stable")
                node, parent, letter = node[order], parent[order], letter[order]
                fresh = np.ones(len(node), dtype=bool)
                fresh[1:] = (node[1:] != node[:-1]) | (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
                node, parent, letter = node[fresh].view(np.int64), parent[fresh].view(np.int64), letter[fresh]
                for i in range(0, len(node), _OUT_ROWS):
                    part = slice(i, i + _OUT_ROWS)
                    yield {"tree": np.full(len(node[part]), tree, dtype=np.int32), "node": node[part], "parent": parent[part],
                           "letter": letter[part].astype(np.int32)}

    return run


def _pairs(seed: int):
    """The integer pairs of a batch of numbered words, with the word's number and role as one number."""

    def run(batch: pa.RecordBatch):
        numbers = batch.column("number").to_numpy(zero_copy_only=False)
        for begin, end, words in _passes(batch):
            letters, sizes, first, start, front, back = _chains(words, seed)
            owner = np.repeat(np.arange(len(words)), sizes)
            place = np.arange(len(letters)) + owner
            leads = np.ones(len(letters), dtype=np.int64)
            leads[1:] = letters[1:] != letters[:-1]
            leads[first] = 1
            mine = numbers[begin:end]
            whole = np.repeat(mine, sizes + 1)
            columns = (np.concatenate((front[place], front)), np.concatenate((back[place + 1], back)),
                       np.concatenate((mine[owner] * 4 + np.where(leads == 1, _FIRST, _INSIDE), whole * 4 + _WHOLE)))
            for i in range(0, len(columns[0]), _OUT_ROWS):
                part = slice(i, i + _OUT_ROWS)
                yield {"front": columns[0][part].view(np.int64), "back": columns[1][part].view(np.int64), "member": columns[2][part]}

    return run


def numbered(words: DataFrame) -> DataFrame:
    """(word, n, number): numbers rise in the order (n downwards, word in code-point order)."""
    order = words.repartitionByRange(F.desc("n"), F.substring("word", 1, 64)).sortWithinPartitions(F.desc("n"), "word")
    return stored(order.select("word", "n", F.monotonically_increasing_id().alias("number")), "words")


def _seed(words: DataFrame) -> int:
    """The first seed with which every node of both tries has a number of its own."""
    seed = 0
    while True:
        nodes = over_batches(words.select("word"), _dictionary(seed), "tree int, node long, parent long, letter int")
        shared = nodes.groupBy("tree", "node").agg(F.min("parent").alias("a"), F.max("parent").alias("b"), F.min("letter").alias("c"), F.max("letter").alias("d"))
        if shared.where("a <> b OR c <> d").isEmpty():
            return seed
        seed += 1


def neighbours(words: DataFrame, seed: int) -> DataFrame:
    """(number, n_near, best) of numbered words with neighbours: how many, and the smallest number among them."""
    pairs = over_batches(words.select("word", "number"), _pairs(seed), "front long, back long, member long")
    groups = pairs.groupBy("front", "back").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    role = lambda m: m % 4
    near = lambda m, x: (x != m) & F.when(role(m) == _WHOLE, role(x) == _FIRST).when(role(x) == _WHOLE, role(m) == _FIRST).otherwise(True)
    each = groups.select("members", F.explode("members").alias("m"))
    each = each.select((F.col("m") / 4).cast("long").alias("number"), F.filter("members", lambda x: near(F.col("m"), x)).alias("near"))
    each = each.where(F.size("near") > 0).select("number", F.size("near").alias("k"), F.array_min("near").alias("best"))
    return each.groupBy("number").agg(F.sum("k").alias("n_near"), F.expr("min(best) div 4").alias("best"))


def variants(counts: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``counts`` (word, n; each word once).

    A word without a neighbour that is ``how.ratio`` times as frequent has no form and is its own root. Ties between forms
    go to the word that is smaller in code-point order. Words of any length take work in proportion to their letters."""
    words = numbered(counts)
    near = stored(neighbours(words, _seed(words)), "near")
    name = lambda prefix: words.select(F.col("number").alias(f"{prefix}_number"), F.col("word").alias(prefix), F.col("n").alias(f"{prefix}_n"))
    forms = near.join(words.select("number", "n"), "number").join(name("form"), F.col("best") == F.col("form_number")) \
        .where(F.col("form_n") >= how.ratio * F.col("n"))
    forms = stored(forms.select("number", "form_number", "form", "form_n"), "forms")
    steps = words.agg(F.max("n")).first()[0] or 1
    chain = forms.select("number", F.col("form_number").alias("to"))
    for _ in range((int(log(steps, how.ratio)) + 1).bit_length()):
        further = chain.select(F.col("number").alias("to"), F.col("to").alias("then"))
        chain = stored(chain.join(further, "to", "left").select("number", F.coalesce("then", "to").alias("to")), "roots")
    roots = chain.join(name("root"), F.col("to") == F.col("root_number")).select("number", "root")
    out = words.join(near.select("number", "n_near"), "number", "left").join(forms, "number", "left").join(roots, "number", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def misspelt(doc_id: Column, run: Column) -> Column:
    """The contract's spelling errors: where 31 divides the CRC-32 of ``<doc_id>:<run>``, the run loses the code point at the
    CRC-32 modulo its length. A null doc_id is written as nothing."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    place = (crc % F.length(run)).cast("int")
    return F.when(crc % 31 == 0, F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))).otherwise(run)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents"), alter=misspelt))
