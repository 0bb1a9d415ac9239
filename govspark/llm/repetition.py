"""Quality rules by repetition: a suffix array over the words of each text finds its maximal repeated substrings.

The texts of a slice are sorted together. Prefix doubling ranks the suffixes by their first 1, 2, 4, … words, with the
document in the first rank, so suffixes of different documents never compare equal; only suffixes that still tie go on.
The ranks of every doubling give the longest common prefix of neighbours in the suffix array. The longest repeat that
starts at a word is the larger of the two common prefixes beside it, that of the deepest interval holding the suffix; the
union of the spans of all maximal repeats is the union of those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from govspark.llm.common import SPACES, over_batches, slices, table, texts_of

#: Characters counted as symbols (fixed values of the rule).
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A text is rejected by the base rule (too few words, too many words in repeated windows) or by the verdict on its
    maximal repeats of at least ``repeat_words`` words: the share of word characters they cover, or the longest of them."""

    min_words: int = 10
    window: int = 5
    max_window_percent: int = 20
    repeat_words: int = 4
    max_covered: float = 0.5
    max_longest: int = 100


def longest_repeats(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each word of concatenated documents, the length in words of the longest substring that starts there and occurs
    elsewhere in the same document. ``words`` and ``docs`` are non-negative ids; rows of a document are adjacent."""
    n = len(words)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    stop = np.searchsorted(docs, docs, side="right")  # end of the word's document
    _, rank = np.unique(docs * (int(words.max()) + 1) + words, return_inverse=True)
    ranks, step = [rank.astype(np.int64)], 1
    # Ranks count the suffixes below, so that a tie has room for the ranks of its members.
    ranks[0] = np.append(0, np.cumsum(np.bincount(ranks[0])))[ranks[0]]
    tied = np.arange(n)
    while True:
        rank = ranks[-1]
        counts = np.bincount(rank[tied], minlength=0)
        tied = tied[counts[rank[tied]] > 1]
        if not len(tied):
            break
        after = tied + step
        inside = after < stop[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[tied]))
        at, first, second = tied[order], rank[tied][order], second[order]
        new_group = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        group_start = np.append(True, first[1:] != first[:-1])
        index = np.arange(len(at))
        offset = np.maximum.accumulate(np.where(new_group, index, 0)) - np.maximum.accumulate(np.where(group_start, index, 0))
        refined = rank.copy()
        refined[at] = first + offset
        ranks.append(refined)
        tied, step = at, step * 2
    return _neighbour_prefixes(ranks, stop, best)


def _neighbour_prefixes(ranks: list[np.ndarray], stop: np.ndarray, best: np.ndarray) -> np.ndarray:
    n = len(best)
    order = np.argsort(ranks[-1], kind="stable")
    left, right = order[:-1], order[1:]
    same = ranks[0][left] == ranks[0][right]
    left, right = left[same], right[same]
    a, b, length = left.copy(), right.copy(), np.zeros(len(left), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, width = ranks[level], 1 << level
        ok = (a < stop[left]) & (b < stop[right])
        hit = ok & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        a, b, length = a + width * hit, b + width * hit, length + width * hit
    np.maximum.at(best, left, length)
    np.maximum.at(best, right, length)
    return best


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in the union of the spans [i, i + lengths[i]) with lengths[i] >= least."""
    starts = np.flatnonzero(lengths >= least)
    edge = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths[starts], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes | None], limits: Limits) -> dict[str, np.ndarray | list]:
    """The columns of ``profile`` for some whole texts."""
    texts = [t or b"" for t in texts]
    n = len(texts)
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    vocabulary: dict[bytes, int] = {}
    flat = [w for words in split for w in words]
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in flat), np.int64, len(flat))
    docs = np.repeat(np.arange(n), sizes)
    chars = np.fromiter((len(w.decode()) for w in vocabulary), np.int64, len(vocabulary))[ids] if flat else ids
    repeats = longest_repeats(ids, docs)
    windows = covered(np.where(repeats >= limits.window, limits.window, 0), limits.window)
    spans = covered(repeats, limits.repeat_words)
    add = lambda x: np.bincount(docs, weights=x, minlength=n).astype(np.int64)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, docs, repeats)
    word_chars, in_windows, span_chars = add(chars), add(windows), add(chars * spans)
    share = span_chars / np.maximum(word_chars, 1)
    failed = (sizes < limits.min_words) | (100 * in_windows > limits.max_window_percent * sizes)
    verdict = (share <= limits.max_covered) & (longest <= limits.max_longest)
    return {"n_words": sizes, "word_chars": word_chars, "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
            "n_dup_lines": [_repeated_lines(t) for t in texts], "n_repeat_words": in_windows, "base_failed": failed,
            "kept": ~failed & verdict, "covered_share": share, "longest_repeat": longest}


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.translate(None, SPACES)]
    return len(lines) - len(set(lines))


PROFILE = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, covered_share double, longest_repeat long")


def profile(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row of measures and the verdict per row of (doc_id, text). Null and empty texts have no words and fail the base
    rule; repeated and null doc_id are measured row by row; other columns are not read."""

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
        for a, b in slices(texts):
            yield {"doc_id": ids[a:b], **measure(texts[a:b], limits)}

    return over_batches(df.select("doc_id", "text"), run, PROFILE)


def keep(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows whose text passes, with all their columns as they are. One narrow pass, no shuffle."""
    schema = df.schema

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                kept = measure(texts[a:b], limits)["kept"]
                part = batch.slice(a, b - a).filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "documents"))
