"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Input of a step is one word: the embedding of the word plus the mean embedding of its character n-grams (a blank
marks both ends, so beginnings and endings count). Windows of WINDOW words overlap by half; a text's score is that of
its worst window, and the network learns from whole labelled texts in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_sample, fold, narrow_batches
from foliospark.llm.langid import plain

#: Words of a window, words between the beginnings of two windows.
WINDOW, STRIDE = 24, 12
#: Lengths of character n-grams in bytes, slots of each embedding table, size of an embedding and of a state.
GRAMS, SLOTS, WIDTH, STATE = (3, 4, 5), 1 << 13, 8, 8
#: Rows of each class that the network is fitted on, at most; characters of a text that it may learn from.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 50_000
#: One clean text in so many gives another that repeats one of its words: such a window is unlike any of real text, so that without clean examples its score is chance.
REPEATED = 4
#: Bytes of text whose windows are computed together; longer texts are cut between words, a window's words repeated.
BATCH_BYTES = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _slots(values: np.ndarray) -> np.ndarray:
    """Hash values to table slots."""
    return ((values ^ (values >> np.uint64(29))) * _MULTIPLIER >> np.uint64(64 - 13)).astype(np.int32)


@dataclass
class Words:
    """Words of several texts one after another: slot of each word and of each of its n-grams."""

    word: np.ndarray
    gram: np.ndarray
    first_gram: np.ndarray  # of each word, and the end
    first_word: np.ndarray  # of each text, and the end


def words_of(texts: list[bytes]) -> Words:
    """texts: as plain() gives them. Every n-gram within a word and its two blanks counts; each word has one at least."""
    joined = np.frombuffer(b"".join(texts) + b" ", np.uint8)
    size = np.array([len(x) for x in texts], np.int64)
    blank = np.flatnonzero(joined[:-1] == 32)
    begins = blank[joined[blank + 1] != 32]
    ends = blank[np.searchsorted(blank, begins, "right")] if len(begins) else begins
    text_ends = np.cumsum(size)
    first_word = np.searchsorted(begins, np.r_[0, text_ends])
    with np.errstate(over="ignore"):
        place = np.cumprod(np.r_[np.uint64(1), np.full(len(joined), 0x100000001B3, np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * place[:-1])]
        inverse = np.uint64(pow(0x100000001B3, -1, 1 << 64))
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(joined), inverse, np.uint64)])

        def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return _slots((total[b] - total[a]) * back[a])

        word = hashed(begins, ends + 1)
        places, owners = [begins], [np.arange(len(begins))]
        slots = [hashed(begins, np.minimum(begins + 3, ends + 1))]
        spans = ends + 1 - begins
        for n in GRAMS:
            count = np.maximum(spans - n + 1, 0)
            owner = np.repeat(np.arange(len(begins)), count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begins[owner]
            places.append(at)
            owners.append(owner)
            slots.append(hashed(at, at + n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return Words(word, np.concatenate(slots)[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(begins)))], first_word)


def words_of_many(texts: list[bytes]) -> Words:
    """words_of() a bounded batch of texts at a time."""
    parts, held = [[]], 0
    for text in texts:
        if held > BATCH_BYTES:
            parts, held = [*parts, []], 0
        parts[-1].append(text)
        held += len(text)
    done = [words_of(p) for p in parts]

    def ends(arrays: list[np.ndarray]) -> np.ndarray:
        ahead = np.cumsum([0] + [int(a[-1]) for a in arrays])
        return np.concatenate([np.zeros(1, np.int64), *[a[1:] + b for a, b in zip(arrays, ahead[:-1], strict=True)]])

    return Words(np.concatenate([x.word for x in done]), np.concatenate([x.gram for x in done]), ends([x.first_gram for x in done]), ends([x.first_word for x in done]))


def window_starts(first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every window; the last window of a text ends with it."""
    n = np.diff(first_word)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    offset = np.minimum(nth * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return first_word[text] + offset, np.minimum(n[text], WINDOW), text


def fresh_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = {"word": normal(SLOTS, WIDTH, scale=0.05), "gram": normal(SLOTS, WIDTH, scale=0.05)}
    w |= {"in": normal(2, WIDTH, 3 * STATE, scale=0.6), "bias": np.zeros((2, 1, 3 * STATE), np.float32), "rec": normal(2, STATE, 3 * STATE, scale=0.3)}
    w |= {"att": normal(2 * STATE, STATE, scale=0.4), "att_bias": np.zeros(STATE, np.float32), "att_out": normal(STATE, scale=0.4)}
    return w | {"out": normal(2 * STATE, scale=0.4), "out_bias": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def embedded(w: dict, words: Words, seen: np.ndarray | None = None, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Vector of each word from begin to end; seen: 0 for words that show their characters alone."""
    end = len(words.word) if end is None else end
    word = w["word"][words.word[begin:end]]
    word = word if seen is None else word * seen[:, None]
    for a in range(begin, end, 32_768):  # the vectors of all n-grams at once would be many times as large
        first = words.first_gram[a : min(a + 32_768, end) + 1]
        grams = np.add.reduceat(w["gram"][words.gram[first[0] : first[-1]]], first[:-1] - first[0])
        word[a - begin : a - begin + len(grams)] += grams / np.diff(first)[:, None].astype(np.float32)
    return word


def logits(w: dict, words: Words, starts: np.ndarray, lengths: np.ndarray, block: int = 4096) -> np.ndarray:
    """Logit of every window, a block of neighbouring windows and their words at a time."""
    found = [np.empty(0, np.float32)]
    for i in range(0, len(starts), block):
        first, n = starts[i : i + block], lengths[i : i + block]
        begin = int(first.min())
        found.append(forward(w, embedded(w, words, None, begin, int((first + n).max())), first - begin, n))
    return np.concatenate(found)


def forward(w: dict, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Logit of each window over the embedded words x; keep: with what backward() needs. Both directions run side by side."""
    index = starts[:, None] + np.minimum(np.arange(WINDOW), lengths[:, None] - 1)
    there = (np.arange(WINDOW) < lengths[:, None]).astype(np.float32)
    full, side = bool(there.all()), np.arange(2)[:, None]
    order, mask = np.stack((index, index[:, ::-1])), np.stack((there, there[:, ::-1]))[..., None]
    states = np.empty((WINDOW, len(starts), 2 * STATE), np.float32)
    gates, h, trace = x @ w["in"] + w["bias"], np.zeros((2, len(starts), STATE), np.float32), []
    for t in range(WINDOW):
        g, r = gates[side, order[:, :, t]], h @ w["rec"]
        zr = _sigmoid(g[..., : 2 * STATE] + r[..., : 2 * STATE])
        z, reset = zr[..., :STATE], zr[..., STATE:]
        new = np.tanh(g[..., 2 * STATE :] + reset * r[..., 2 * STATE :])
        after = new + z * (h - new)
        if not full:
            after = np.where(mask[:, :, t] > 0, after, h)
        if keep:
            trace.append((h, z, reset, new, r[..., 2 * STATE :]))
        h = after
        states[t, :, :STATE], states[WINDOW - 1 - t, :, STATE:] = h[0], h[1]
    saved = {"order": order, "mask": mask, "x": x, "trace": trace}
    hidden = np.tanh(states @ w["att"] + w["att_bias"])
    weight = hidden @ w["att_out"]
    if not full:
        weight = np.where(there.T > 0, weight, np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    logit = pooled @ w["out"] + w["out_bias"]
    return (logit, saved | {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled}) if keep else logit


def backward(w: dict, words: Words, seen: np.ndarray, s: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["out_bias"] = s["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * w["out"]
    d_states = s["weight"][:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", s["states"], d_pooled)
    d_score = s["weight"] * (d_weight - (s["weight"] * d_weight).sum(axis=0))
    g["att_out"] = np.einsum("tb,tba->a", d_score, s["hidden"])
    d_hidden = d_score[:, :, None] * w["att_out"] * (1 - s["hidden"] ** 2)
    g["att"], g["att_bias"] = np.einsum("tbh,tba->ha", s["states"], d_hidden), d_hidden.sum(axis=(0, 1))
    d_states += d_hidden @ w["att"].T
    d_gates, carry, side = np.zeros((2, len(s["x"]), 3 * STATE), np.float32), 0, np.arange(2)[:, None]
    for t in range(WINDOW - 1, -1, -1):
        h, z, reset, new, rec = s["trace"][t]
        d_h = np.stack((d_states[t, :, :STATE], d_states[WINDOW - 1 - t, :, STATE:])) + carry
        there = s["mask"][:, :, t]
        skipped, d_h = d_h * (1 - there), d_h * there
        d_new = d_h * (1 - z) * (1 - new**2)
        d_z = d_h * (h - new) * z * (1 - z)
        d_r = d_new * rec * reset * (1 - reset)
        d_rec = np.concatenate((d_z, d_r, d_new * reset), axis=2)
        g["rec"] += h.transpose(0, 2, 1) @ d_rec
        carry = d_h * z + d_rec @ w["rec"].transpose(0, 2, 1) + skipped
        d_gates[side, s["order"][:, :, t]] += np.concatenate((d_z, d_r, d_new), axis=2)  # at one step no two windows meet a word
    g["in"], g["bias"] = s["x"].T @ d_gates, d_gates.sum(axis=1, keepdims=True)
    d_x = (d_gates @ w["in"].transpose(0, 2, 1)).sum(axis=0)
    count = np.diff(words.first_gram)
    g["word"] = _summed(words.word, d_x * seen[:, None])
    g["gram"] = _summed(words.gram, np.repeat(d_x / count[:, None], count, axis=0))
    return g


def _summed(slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of each slot."""
    return np.stack([np.bincount(slots, rows[:, i], SLOTS) for i in range(WIDTH)], axis=1)


def _chosen(words: Words, starts: np.ndarray, lengths: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of some windows alone."""

    def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)

    at = ranges(starts, lengths)
    grams = np.diff(words.first_gram)[at]
    own = Words(words.word[at], words.gram[ranges(words.first_gram[at], grams)], np.r_[0, np.cumsum(grams)], np.r_[0, len(at)])
    return own, np.cumsum(lengths) - lengths


def train(texts: list[str | None], labels: list[int], seed: int = 3, warm_steps: int = 100, steps: int = 100, epochs: int = 2, batch: int = 128, rate: float = 0.01, blind: float = 0.3) -> dict[str, np.ndarray]:
    """Weights fitted to whole labelled texts.

    First every text gives two windows at random; then, epoch by epoch, its worst window by the network so far (and,
    for clean texts, one more at random). Few texts make more epochs, so that the number of steps stays about the
    same. A share of the words (blind) shows its characters alone. Without both classes every text
    gets the share of toxic ones among those seen, as if twenty more had been seen of which one is toxic.
    """
    rng, w = np.random.default_rng(seed), fresh_weights(seed)
    texts, labels = [plain(x or "") for x in texts], list(labels)
    for clean in [x.split() for x, y in zip(texts, labels, strict=True) if y == 0 and x.strip()][::REPEATED]:
        word = clean[int(rng.random() * len(clean))]
        texts.append(b" " + b" ".join([word] * WINDOW) + b" ")
        labels.append(0)
    words = words_of_many(texts)
    starts, lengths, owner = window_starts(words.first_word)
    label = np.asarray(labels, np.float32)
    if len(set(labels)) < 2 or not len(starts):
        w["out"][:], w["out_bias"][:] = 0, np.log((1 + label.sum()) / (20 + len(label) - label.sum()))
        return w
    first = np.searchsorted(owner, np.arange(len(label)))
    n = np.bincount(owner, minlength=len(label))
    some = np.flatnonzero(n)
    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}, 0
    warm_epochs = -(-warm_steps * batch // (2 * len(some)))
    epochs = max(epochs, -(-steps * batch // (2 * len(some))))
    for epoch in range(warm_epochs + epochs):
        random = [first[some] + (rng.random(len(some)) * n[some]).astype(np.int64) for _ in range(2)]
        if epoch < warm_epochs:
            picked = np.concatenate(random)
        else:
            logit = logits(w, words, starts, lengths)
            worst = np.lexsort((-logit, owner))[first[some]]
            picked = np.concatenate((worst, random[0][label[some] == 0]))
        picked = rng.permutation(picked)
        for i in range(0, len(picked), batch):
            rows = picked[i : i + batch]
            own, at = _chosen(words, starts[rows], lengths[rows])
            y = label[owner[rows]]
            seen = (rng.random(len(own.word)) >= blind).astype(np.float32)
            logit, saved = forward(w, embedded(w, own, seen), at, lengths[rows], keep=True)
            gradient = backward(w, own, seen, saved, ((_sigmoid(logit) - y) / len(rows)).astype(np.float32))
            step += 1
            for k, (m, v) in moments.items():
                d = gradient[k] + np.float32(1e-4) * w[k] * (k in ("word", "gram"))
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w[k] = (w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def _parts(text: bytes) -> Iterator[bytes]:
    """A text as plain() gives it, in parts of bounded size that share the words of a window."""
    while len(text) > 2 * BATCH_BYTES:
        cut = text.find(b" ", BATCH_BYTES, 2 * BATCH_BYTES)
        if cut < 0:  # a word as long as that is cut
            yield text[:BATCH_BYTES] + b" "
            text = b" " + text[BATCH_BYTES:]
            continue
        yield text[: cut + 1]
        back = cut
        for _ in range(WINDOW):
            back = text.rfind(b" ", max(0, cut - BATCH_BYTES // 2), back)
            if back < 0:
                break
        text = text[cut if back < 0 else back :]
    yield text


def scores(w: dict, texts: Iterator[str | None]) -> np.ndarray:
    """Score of each whole text: of its worst window; null and wordless texts score 0."""
    parts, owner, held = [], [], 0
    texts = list(texts)
    best = np.full(len(texts), -np.inf, np.float32)

    def flush() -> None:
        nonlocal parts, owner, held
        words = words_of(parts)
        starts, lengths, text = window_starts(words.first_word)
        if len(starts):
            np.maximum.at(best, np.asarray(owner)[text], logits(w, words, starts, lengths))
        parts, owner, held = [], [], 0

    for i, text in enumerate(texts):
        for part in _parts(plain(text or "")):
            if part.strip():
                parts.append(part)
                owner.append(i)
                held += len(part)
            if held > BATCH_BYTES:
                flush()
    if parts:
        flush()
    return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-best.astype(np.float64))))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, seed: int = 11) -> list:
    """(doc_id, text, toxic) of at most sample_rows labelled documents a class, drawn by a seeded hash of the id.

    Labels join on doc_id. Rows with a null id, text or label and texts of more than sample_chars characters teach
    nothing; of several texts of one id the one with the least hash does, and an id with both labels counts in both
    classes. So at most 2 * sample_rows rows reach the driver, the same ones on every run.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic", order.alias("order"))
    known = bounded_sample(known, "toxic", "order", sample_rows).drop("order")
    texts = docs.where(F.length("text") <= sample_chars).select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")).collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["toxic"]))


def toxicity(text: Column, weights: dict[str, np.ndarray]) -> Column:
    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(weights, texts))

    return apply(text)


def fitted(docs: DataFrame, labels: DataFrame, **options) -> dict[str, np.ndarray]:
    rows = training_rows(docs, labels, **options)
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_documents(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """docs (doc_id, text) to doc_id, score, predicted; one row per input row.

    Null, empty and wordless texts score 0. Repeated rows stay and score the same, a null doc_id stays null, other
    columns are left out, an empty table gives an empty one.
    """
    found = narrow_batches(docs).select("doc_id", toxicity(F.col("text"), weights).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    found = score_documents(docs, fitted(docs, labels))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
