"""Licence scan: winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans.

The templates are a bounded table that travels with the tasks: their winnowed word-k-gram fingerprints form an inverted
index from hash to places, in which all k-grams of a text are looked up. What a match may differ by (a share of
1 - COVERAGE of the aligned words) leaves a run of equal words that always holds a fingerprint: windows grow with the
length of the template. Around the hits the words are aligned within a band, inserted and replaced words count against
a match, words that tell licences apart must agree, and of overlapping matches the best is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import narrow_batches
from foliospark.llm.license_texts import TELLING, TEMPLATES

#: Least share of matched words among all words of an alignment: the template's and those put in or replaced.
COVERAGE = 0.8
#: Words of a template (an alignment's table grows with their square) and of all of an index (it travels with the tasks) at most; more raise.
MOST_WORDS, MOST_OF_ALL = 8_000, 2_000_000
#: Points of a match, a replaced word, a word left out or put in.
MATCH, REPLACED, GAP = 2, -1, -1
#: Bytes of surroundings whose alignments an index keeps.
MOST_HELD = 32_000_000
#: Bytes of a text whose words are found at once.
BLOCK = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x100000001B3


def _block_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    inside = np.r_[False, _WORD[data], False]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = change[::2], change[1::2]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _BASE, np.uint64)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])]
        return (total[ends] - total[begins]) * back[begins], begins, ends


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word: runs of ASCII letters and digits, lower case, and of bytes beyond ASCII.

    A long text is taken a block at a time, cut between words, so only 24 bytes a word are held for all of it.
    """
    parts, begin, text = [], 0, text.lower()
    while begin < len(text) or not parts:
        end = min(begin + BLOCK, len(text))
        while end < len(text) and _WORD[text[end]] and _WORD[text[end - 1]]:
            end += 1
        hashes, begins, ends = _block_words(text[begin:end])
        parts.append((hashes, begins + begin, ends + begin))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def grams_of(words: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = max(0, len(words) - gram + 1)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for i in range(1, gram):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the chosen k-grams: of every window the least, the last of equal ones."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(windows)) + window - 1 - np.argmin(windows[:, ::-1], axis=1))


def differences(n: int, coverage: float) -> list[tuple[int, int]]:
    """What a match of a template of n words may differ by: for each number of replaced or missing words the most words put in."""
    return [(s, int((n - s) / coverage - n + 1e-9)) for s in range(int((1 - coverage) * n + 1e-9) + 1)]


def slack(n: int, coverage: float) -> int:
    """How far a match may drift from its diagonal."""
    return max(1, *(max(s, i) for s, i in differences(n, coverage)))


def scheme(n: int, coverage: float) -> tuple[int, int]:
    """Words of a k-gram and k-grams of a window that no match of a template of n words escapes.

    The words that stay stand together in runs between those that differ; the longest run is at least this long, and
    a run of gram + window - 1 equal words holds a chosen k-gram.
    """
    run = min(-(-(n - s) // (s + i + 1)) for s, i in differences(n, coverage))
    gram = min(3, run)
    return gram, run - gram + 1


def least_hits(places: np.ndarray, gram: int, n: int, coverage: float) -> int:
    """Chosen k-grams that every match holds: all but those that the worst differences spoil, by a word or by a gap."""
    begins = places[:, None]
    word = np.sort(((begins <= np.arange(n)) & (begins > np.arange(n) - gram)).sum(axis=0))[::-1]
    gap = np.sort(((begins < np.arange(1, n)) & (begins > np.arange(1, n) - gram)).sum(axis=0))[::-1]
    spoilt = max(int(word[:s].sum() + gap[:i].sum()) for s, i in differences(n, coverage))
    return max(1, len(places) - spoilt)


@dataclass
class Template:
    license: str
    name: str
    words: np.ndarray
    telling: np.ndarray  # which of its words tell it apart
    least_hits: int  # fingerprints that a match has at least


class Index:
    """Inverted index of the templates (licence, template, text)."""

    def __init__(self, templates: list, coverage: float = COVERAGE, telling: tuple = TELLING) -> None:
        self.coverage = coverage
        self.telling = np.unique(np.concatenate([words_of(w.encode())[0] for w in (*telling, *map(str, range(10)))]))
        self.templates, found = [], []
        for license_, name, text in templates:
            words = words_of(text.encode())[0]
            if not len(words):
                continue
            if len(words) > MOST_WORDS or sum(len(t.words) for t in self.templates) > MOST_OF_ALL:
                raise ValueError(f"a template has more than {MOST_WORDS} words, or all have more than {MOST_OF_ALL}")
            gram, window = scheme(len(words), coverage)
            grams = grams_of(words, gram)
            places = winnowed(grams, window)
            found += [(gram, int(h), len(self.templates), int(p)) for h, p in zip(grams[places], places, strict=True)]
            self.templates.append(Template(license_, name, words, np.isin(words, self.telling), least_hits(places, gram, len(words), coverage)))
        self.known: dict[tuple, tuple | None] = {}
        self.held = 0
        self.tables = {}
        for gram in {f[0] for f in found}:
            own = sorted(f[1:] for f in found if f[0] == gram)
            hashes = np.array([f[0] for f in own], np.uint64)
            there = np.zeros(1 << 20, bool)
            there[hashes >> np.uint64(44)] = True
            self.tables[gram] = hashes, np.array([f[1] for f in own], np.int64), np.array([f[2] for f in own], np.int64), there

    def judged(self, n: int, words: np.ndarray, diagonal: int) -> tuple | None:
        """_judged() of a template near a diagonal; equal surroundings, as files of one project have them, are aligned once."""
        t = self.templates[n]
        drift = slack(len(t.words), self.coverage)
        begin = max(0, diagonal - drift)
        window = words[begin : diagonal + len(t.words) + drift]
        key = n, diagonal - begin, window.tobytes()
        if key not in self.known:
            if self.held > MOST_HELD:
                self.known.clear()
                self.held = 0
            self.held += len(key[2]) + 200
            self.known[key] = _judged(self, t, window, diagonal - begin)
        match = self.known[key]
        return match and (*match[:2], match[2] + begin, match[3] + begin)

    def hits(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each template (place in the text, place in the template) of every shared fingerprint, in order."""
        rows = []
        for gram, (known, owner, place, there) in self.tables.items():
            grams = grams_of(words, gram)
            where = np.flatnonzero(there[grams >> np.uint64(44)])
            first, last = np.searchsorted(known, grams[where], "left"), np.searchsorted(known, grams[where], "right")
            n = last - first
            if n.any():
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                rows.append(np.stack((owner[at], np.repeat(where, n), place[at]), axis=1))
        if not rows:
            return {}
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        return {int(part[0, 0]): part[:, 1:] for part in np.split(rows, cuts[1:])}


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Best alignment of a template with a text around text place - template place: pairs (text place or -1, template place or -1), from the first matched word to the last.

    The text may be any part; the template's words outside of the pairs are left out.
    """
    width = 2 * band + 1
    score = np.zeros(width, np.int32)
    step = np.zeros((len(template) + 1, width), np.int8)  # 0 stop, 1 both, 2 template only, 3 text only
    drift = np.arange(width) * GAP
    padded = np.r_[np.zeros(band, np.uint64), text, np.zeros(band, np.uint64)]  # places of the window outside of the text are masked below
    best, end = 0, None
    for i in range(1, len(template) + 1):
        first = i - 1 + diagonal - band
        low, high = max(0, -first), min(width, len(text) - first)
        inside = np.zeros(width, bool)
        same = np.zeros(width, bool)
        if low < high:
            inside[low:high] = True
            same[low:high] = padded[first + low + band : first + high + band] == template[i - 1]
        both = np.where(inside, score + np.where(same, MATCH, REPLACED), -9)
        above = np.r_[score[1:] + GAP, -9]
        row = np.maximum(np.maximum(both, above), 0)
        beside = np.maximum.accumulate(row - drift) + drift
        score = np.where(inside, np.maximum(row, beside), row)
        step[i] = np.where(score == 0, 0, np.where(score == both, 1, np.where(score == above, 2, 3)))
        top = int(score.argmax())
        if score[top] > best:
            best, end = int(score[top]), (i, top)
    pairs = []
    if end is not None:
        i, j = end
        while i > 0 and step[i, j]:
            place = i - 1 + diagonal + j - band
            pairs.append((place if step[i, j] != 2 else -1, i - 1 if step[i, j] != 3 else -1))
            i, j = (i - 1, j) if step[i, j] == 1 else (i - 1, j + 1) if step[i, j] == 2 else (i, j - 1)
    return pairs[::-1]


def in_band(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> np.ndarray:
    """Which of a template's words an alignment around a diagonal can match: those that the text has within the band."""
    begin = max(0, diagonal - band)
    window = text[begin : diagonal + len(template) + band]
    if not len(window):
        return np.zeros(len(template), bool)
    order = np.argsort(window, kind="stable")  # the places of each word stand together, in order
    ranked = window[order]
    word, base = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]]), len(window) + 1
    low, high = np.searchsorted(ranked, template, "left"), np.searchsorted(ranked, template, "right")
    first = np.arange(len(template)) + diagonal - band - begin  # where the band begins for each word of the template
    at = np.searchsorted(word * base + order, word[np.minimum(low, len(window) - 1)] * base + np.maximum(first, 0))
    return (at >= low) & (at < high) & (order[np.minimum(at, len(window) - 1)] <= first + 2 * band)


def _judged(index: Index, t: Template, words: np.ndarray, diagonal: int) -> tuple[int, float, int, int] | None:
    """(matched words, coverage, first and past-last place in the text) of a template near a diagonal; None for less than the index's coverage or another telling word."""
    drift = slack(len(t.words), index.coverage)
    there = np.isin(t.words, words[max(0, diagonal - drift) : diagonal + len(t.words) + drift])
    if there.sum() < index.coverage * len(t.words) - 1e-9 or not there[t.telling].all():
        return None  # no alignment can hold more
    there = in_band(t.words, words, diagonal, drift)
    if there.sum() < index.coverage * len(t.words) - 1e-9 or not there[t.telling].all():
        return None
    pairs = align(t.words, words, diagonal, drift)
    if not pairs:
        return None
    text, own = np.array(pairs).T
    same = (text >= 0) & (own >= 0)
    same[same] = words[text[same]] == t.words[own[same]]
    matched = int(same.sum())
    columns = len(pairs) + len(t.words) - len({int(x) for x in own if x >= 0})
    if matched < index.coverage * columns - 1e-9 or t.telling.sum() != t.telling[own[same]].sum():
        return None
    extra = words[text[(text >= 0) & ~same]]
    if np.isin(extra, index.telling).any():
        return None
    places = text[same]
    return matched, matched / columns, int(places[0]), int(places[-1]) + 1


def matches_of(text: bytes | None, index: Index) -> list[dict]:
    """Matches of one whole text, in order of place: licence, template, matched words, coverage, character span. Of overlapping ones the best stays."""
    if not text:
        return []
    words, begins, ends = words_of(text)
    found = []
    for n, hits in index.hits(words).items():
        t = index.templates[n]
        drift = slack(len(t.words), index.coverage)
        reach = len(t.words) + drift
        done = -1
        tried: dict[int, tuple | None] = {}  # what an alignment finds depends on the diagonal alone
        for k, (place, own) in enumerate(hits.tolist()):
            diagonal = place - own
            if place < done or tried.get(diagonal, 0) is None:
                continue
            near = hits[k : np.searchsorted(hits[:, 0], place + reach)]
            near = near[np.abs(near[:, 0] - near[:, 1] - diagonal) <= drift]
            if len(np.unique(near[:, 1])) < t.least_hits:
                continue
            diagonals, n_hits = np.unique(near[:, 0] - near[:, 1], return_counts=True)
            for d in dict.fromkeys((int(diagonals[n_hits.argmax()]), diagonal)):  # where most hits lie, then the hit's own
                if d not in tried:
                    tried[d] = index.judged(n, words, d)
                match = tried[d]
                if match and match[3] > place:
                    found.append((n, *match))
                    done = match[3]
                    break
    # the most matched words first, then the closest, then the first by name
    found.sort(key=lambda f: (-f[1], -f[2], f[3], index.templates[f[0]].license, index.templates[f[0]].name))
    kept, taken = [], np.zeros(len(words) + 1, bool)
    for n, matched, share, first, last in found:
        if not taken[first:last].any():
            taken[first:last] = True
            kept.append((first, last, index.templates[n], matched, share))
    out = []
    for first, last, t, matched, share in sorted(kept, key=lambda x: x[0]):
        a, b = int(begins[first]), int(ends[last - 1])
        begin = len(text[:a].decode("utf-8", "replace"))
        out.append({"license": t.license, "template": t.name, "matched": matched, "coverage": share, "begin": begin, "end": begin + len(text[a:b].decode("utf-8", "replace"))})
    return out


def templates_of(table: DataFrame) -> list[tuple[str, str, str]]:
    """The rows of a table (license, template, text), in order; so many words as an index takes, or it raises."""
    n = table.agg(F.sum(F.regexp_count("text", F.lit(r"[^\s]+")))).first()[0] or 0
    if n > MOST_OF_ALL:
        raise ValueError(f"the templates have more than {MOST_OF_ALL} words")
    return [tuple(r) for r in table.where("text is not null").select("license", "template", "text").orderBy("license", "template", "text").collect()]


def license_matches(text: Column, templates: list = TEMPLATES, coverage: float = COVERAGE) -> Column:
    """Array of matches of each whole text."""
    index = Index(templates, coverage)

    @F.pandas_udf("array<struct<license:string,template:string,matched:int,coverage:double,begin:int,end:int>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([matches_of(x, index) for x in texts], dtype=object)

    return apply(text.cast("binary"))


def scan_licenses(docs: DataFrame, templates: list | DataFrame = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """docs (doc_id, text) to one row per match: doc_id, license, template, matched words, coverage, begin and end in characters.

    templates: (license, template, text) as a list or a table, whole licence texts of up to MOST_WORDS words among them.

    coverage is the share of matched words among all words of the alignment; every span with at least the asked one is
    found. A template whose telling words (numbers, "lesser", "noncommercial" and the like) differ isn't reported. Of
    overlapping matches the one with the most matched words stays, then the one with the higher coverage, then the one
    that begins first, then the first by licence and template. Null, empty and very short texts match nothing; long
    ones are scanned whole; repeated rows give repeated matches, a null doc_id stays null, other columns are left out,
    an empty table gives an empty one.
    """
    templates = templates_of(templates) if isinstance(templates, DataFrame) else templates
    found = narrow_batches(docs).select("doc_id", license_matches(F.col("text"), templates, coverage).alias("found"))
    return found.select("doc_id", F.explode_outer("found").alias("m")).where("m is not null").select("doc_id", "m.*")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
