"""Maximal repetitions of words by descending-LCP Kruskal.

Suffixes of a text's words are sorted, and neighbours in that order are edges weighted by their longest common prefix
(LCP). Edges are taken from the greatest LCP down; each unites two classes of suffixes (union-find), and a class keeps
its positions in order. Positions that become neighbours at distance d with LCP l >= d hold a square there, and a
stretch of period d from the first position for d + l words. The stretch is a run where no word before it goes on with
the period. A neighbour at the smallest period is met first: positions one period apart have the greater LCP.

Only positions whose first words come again can seed a run of the least length asked for, so suffixes are sorted among
those; a text without such repeats costs one hash a word.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, narrow_batches, table

#: Positions of one part of an ordered set.
PART = 1024

_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Positions:
    """Ordered whole numbers in parts of bounded size: an insertion moves one part only."""

    def __init__(self, first: int) -> None:
        self.parts, self.last, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        return (x for part in self.parts for x in part)

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The nearest member below x and the nearest above; x itself is no member."""
        k = bisect_left(self.last, x)
        if k == len(self.parts):
            return self.last[-1], None
        part = self.parts[k]
        i = bisect_left(part, x)
        return part[i - 1] if i else self.last[k - 1] if k else None, part[i]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.last, x), len(self.parts) - 1)
        part = self.parts[k]
        insort(part, x)
        if len(part) > PART:
            self.parts[k : k + 1] = part[: PART // 2], part[PART // 2 :]
            self.last[k : k + 1] = part[PART // 2 - 1], part[-1]
        else:
            self.last[k] = part[-1]
        self.size += 1


def _repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """Positions whose next n words, or an equal hash of them, come more than once."""
    mixed = np.full(len(ids) - n + 1, _SEED)
    for i in range(n):
        mixed = (mixed ^ (ids[i : len(ids) - n + 1 + i].astype(np.uint64) + _SEED)) * _STEP
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    return np.sort(order[np.r_[same, False] | np.r_[False, same]])


def _sorted_suffixes(ids: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kept positions in the order of their suffixes, and the LCP of each with the one before it (0 for the first).

    Ranks of stretches of doubled lengths are made until all differ (prefix doubling); those ranks then give the LCPs.
    """
    n, levels, width = len(ids), [np.r_[ids, -1]], 1
    while True:
        rank = levels[-1]
        at = np.arange(n)
        after = rank[np.minimum(at + width, n)]
        own = rank[:n] * np.int64(n + 2) + after + 1
        if width > n or len(np.unique(own[kept])) == len(kept):
            break
        levels.append(np.r_[np.unique(own, return_inverse=True)[1], -1])
        width *= 2
    order = kept[np.argsort(own[kept], kind="stable")]
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.maximum(a, b) + (1 << k) <= n
        fits &= levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]
        step = fits.astype(np.int64) << k
        a, b, lcp = a + step, b + step, lcp + step
    return order, np.r_[0, lcp]


def runs_of(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least least words and times its period, by start, then period; times is 2 or more."""
    need = min(max(least, times * d) - d for d in range(1, max(2, least) + 1))  # the least LCP that can seed a run
    if len(ids) < max(least, times):
        return []
    kept = _repeated(ids, need)
    if len(kept) < 2:
        return []
    order, lcp = _sorted_suffixes(ids, kept)
    places, values = order.tolist(), ids.tolist()
    edges = np.flatnonzero(lcp >= need)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent, sets, found = list(range(len(places))), {}, []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for e, length in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        i, j = root(e - 1), root(e)
        big, small = sets.pop(i, None) or Positions(places[i]), sets.pop(j, None) or Positions(places[j])
        if big.size < small.size:
            big, small, i, j = small, big, j, i
        parent[j] = i
        seeds, own = [], list(small)
        for x, before, after in zip(own, [-1, *own], [*own[1:], len(ids)], strict=False):
            below, above = big.around(x)  # what becomes a neighbour across the two sets shares exactly the present LCP
            if below is not None and below > before:
                seeds.append((below, x))
            if above is not None and above < after:
                seeds.append((x, above))
        for x in own:
            big.add(x)
        sets[i] = big
        for s, t in seeds:
            d = t - s
            if length >= (times - 1) * d and length + d >= least and (not s or values[s - 1] != values[t - 1]):
                found.append((s, length + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def periodic_runs(text: Column, least: int = 6, times: int = 4) -> Column:
    """Struct of a text's runs, array of (start, length, period) by start, then period, and the text without their repeats.

    A run is a stretch of consecutive words with a smallest period that neither neighbour goes on with, of at least
    least words and times its period. Words are stretches without white space, numbered from 0. In collapsed the words
    that a run holds after its first period are left out and the others joined by one blank. Null, empty and blank
    texts have no runs and an empty collapsed text. Texts are read whole, however long: a text of n words takes some
    n log n steps and lists of a few times its size in one task, also where one word is repeated throughout.
    """

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            runs, kept = [], []
            for raw in texts:
                words = (raw or b"").split()
                known: dict[bytes, int] = {}
                ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                found = runs_of(ids, least, times)
                if found:
                    words = [words[i] for i in np.flatnonzero(collapsed_words(len(words), found)).tolist()]
                runs.append([{"start": s, "length": n, "period": d} for s, n, d in found])
                kept.append(b" ".join(words).decode())
            yield pd.DataFrame({"runs": runs, "collapsed": kept})

    return apply(text.cast("binary"))


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; ties go to the smallest start, then period; null without runs."""
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def run_lines(runs: Column) -> Column:
    """Every run as `start,length,period` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def document_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """docs (doc_id, text) to doc_id, runs, best (most_repeated) and collapsed; one row per input row.

    Repeated rows stay repeated; null ids stay; other columns are left out; an empty table gives an empty one. Each
    text is worked on where it lies, nothing is shuffled.
    """
    found = narrow_batches(docs).select("doc_id", periodic_runs(F.col("text"), least, times).alias("r"))
    return found.select("doc_id", "r.runs", most_repeated(F.col("r.runs")).alias("best"), "r.collapsed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the words of one document in ten, chosen by the id's checksum, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    sized = marked.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    place = lambda w, i: F.element_at("words", (F.col("a") + i.cast("long") % F.col("p") + 1).cast("int"))
    rest = F.transform(F.slice("words", F.col("a").cast("int") + 1, F.greatest((F.col("n") - F.col("a")).cast("int"), F.lit(0))), place)
    planted = F.array_join(F.concat(head, rest), " ")
    return sized.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = document_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
