"""SentencePiece encoding and decoding by a Viterbi forward pass that distinct words share along their prefixes.

A text is cut before each run of blanks, and between characters that no piece joins, into marked words and what
follows them; no piece crosses such a cut. The distinct words are sorted, which is the depth-first order of their trie,
and the forward table of the last word is kept up to the common prefix with the next one, so every node of the trie is
worked out once. The table holds, for each prefix, the best score of any way to cut it into pieces, and the last piece
of that way. The pieces that may end a prefix are those of a state of Aho and Corasick's automaton over all pieces.

A piece adds a score that may depend on the piece before it. In a unigram model it is the piece's own. The scores of a
BPE model are merge ranks, whose sum means nothing; there a piece adds 0 where the merges leave the seam between the two
open and minus infinity where an earlier merge closes it. One way alone has no closed seam, so the best score is that
of the model's own cut, and a prefix is done with as soon as a piece reaches 0. Both give what the model's own library
gives.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import narrow_batches

#: The sign that stands for a blank.
MARK = "▁"
#: Where the public model lies by default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of distinct words, and pairs of pieces or steps of the automaton, that a task keeps at most; beyond that it starts anew.
CACHE_CHARS, FOLLOWERS = 8_000_000, 300_000

#: Kinds of characters: those that no piece joins with another one, and blanks. Others follow, a kind for each set of characters that pieces join.
_ALONE, _BLANK = 0, 1


@dataclass
class PieceModel:
    """What encoding needs of a model file: bounded by the vocabulary, so it travels with the tasks."""

    kind: str  # "unigram" or "bpe"
    ids: dict[str, int]
    score: dict[str, float]
    bytes_of: list[bytes]
    byte_ids: list[int]
    unknown: int
    prefix: bool
    squeeze: bool
    rank: dict[str, int] = field(default_factory=dict)
    split: dict[str, tuple[str, str] | None] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)  # of characters that pieces join with others


def load_model(path: str = MODEL) -> PieceModel:
    """Reads a model on the driver; only models without character normalisation are taken."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    return model_of(proto)


def model_of(proto) -> PieceModel:
    normal, trainer = proto.normalizer_spec, proto.trainer_spec
    if normal.precompiled_charsmap or not normal.escape_whitespaces or trainer.treat_whitespace_as_suffix or trainer.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models with identity normalisation and leading marks are supported")
    ids, score, shown, byte_ids, unknown = {}, {}, [], [-1] * 256, 0
    for i, p in enumerate(proto.pieces):
        if p.type == 1:  # normal
            ids[p.piece], score[p.piece] = i, p.score
            shown.append(p.piece.replace(MARK, " ").encode())
        elif p.type == 6:  # one byte, as <0x..>
            byte_ids[int(p.piece[3:5], 16)] = i
            shown.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type == 4:
            raise ValueError("user-defined pieces are not supported")
        else:
            unknown = i if p.type == 2 else unknown
            shown.append(" ⁇ ".encode() if p.type == 2 else b"")
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece holds a mark after another character")
    model = PieceModel("bpe" if trainer.model_type == 2 else "unigram", ids, score, shown, byte_ids if min(byte_ids) >= 0 else [], unknown, normal.add_dummy_prefix, normal.remove_extra_whitespaces)
    if model.kind == "bpe":
        _merges(model)
    model.kinds = _kinds(ids)
    return model


def _kinds(pieces: Iterable[str]) -> dict[str, int]:
    """A number for each character that some piece joins with another one, marks in front left out; it differs where no chain of pieces joins two."""
    top: dict[str, str] = {}

    def root(c: str) -> str:
        while top.setdefault(c, c) != c:
            top[c] = c = top[top[c]]
        return c

    for p in pieces:
        bare = p.lstrip(MARK)
        for a, b in itertools.pairwise(bare):
            top[root(a)] = root(b)
    number: dict[str, int] = {}
    return {c: number.setdefault(root(c), len(number) + _BLANK + 1) for c in list(top)}


def _merges(model: PieceModel) -> None:
    """Rank of each piece that merges can make, and the two pieces it is last made from. Pieces of marks alone come later."""
    marks = {p for p in model.ids if not p.strip(MARK) and len(p) > 1}
    rest = [p for p in model.ids if p not in marks]
    if marks and max(model.score[p] for p in marks) >= min((model.score[p] for p in rest if len(p) > 1), default=0.0):
        raise ValueError("pieces of blanks have to come last among the merges")
    for p in rest:
        if len(p) == 1:
            model.rank[p], model.split[p] = -1, None
    for n, p in enumerate(sorted((p for p in rest if len(p) > 1), key=lambda p: -model.score[p])):
        for cut in range(1, len(p)):
            a, b = p[:cut], p[cut:]
            if a in model.rank and b in model.rank and may_follow(model, a, b):
                model.rank[p], model.split[p] = n, (a, b)
                break


def may_follow(model: PieceModel, a: str, b: str) -> bool:
    """Whether merging the text of a and b ends with just these two pieces.

    The later of the two merges that made a and b is undone again and again; at each step the pair at the seam must
    not have been able to merge before what has been undone.
    """
    rank, split = model.rank, model.split
    limit = 1 << 40
    while True:
        joined = rank.get(a + b)
        if joined is not None and joined < limit:
            return False
        left, right = rank[a], rank[b]
        if left < 0 and right < 0:
            return True
        if left > right:
            limit, a = left, split[a][1]
        else:
            # on the right an equal rank to the left of the seam still comes first
            limit, b = right + 1, split[b][0]


def blanks(model: PieceModel, n: int, known: dict[int, list[int]]) -> list[int]:
    """Ids of n marks: merges of equal score go from left to right."""
    if n not in known:
        sizes, k = [1] * n, 0
        longest = max((len(p) for p in model.ids if not p.strip(MARK)), default=1)
        have = {len(p) for p in model.ids if not p.strip(MARK)}
        while k < len(sizes) - 1:
            if sizes[k] + sizes[k + 1] <= longest and sizes[k] + sizes[k + 1] in have:
                sizes[k : k + 2] = [sizes[k] + sizes[k + 1]]
                k = max(0, k - 1)
            else:
                k += 1
        known[n] = [i for s in sizes for i in _ids(model, MARK * s)]
    return known[n]


def _ids(model: PieceModel, piece: str) -> list[int]:
    own = model.ids.get(piece)
    if own is not None:
        return [own]
    return [model.byte_ids[b] for b in piece.encode("utf-8", "replace")] if model.byte_ids else [model.unknown]


class After(dict):
    """Whether each other piece of a BPE model may come after one piece, worked out when first asked for."""

    __slots__ = ("forward", "known", "piece", "size")

    def __init__(self, forward: SharedForward, piece: str) -> None:
        self.forward, self.piece, self.size, self.known = forward, piece, len(piece), piece in forward.model.rank

    def __missing__(self, piece: str) -> bool:
        self.forward.n_kept += 1
        value = self[piece] = not self.known or may_follow(self.forward.model, self.piece, piece)
        return value


class Follows(dict):
    """For each piece of a BPE model, or character that it doesn't have, which pieces may come next."""

    __slots__ = ("forward",)

    def __init__(self, forward: SharedForward) -> None:
        self.forward = forward

    def __missing__(self, piece: str) -> After:
        value = self[piece] = After(self.forward, piece)
        return value


class State(dict):
    """The longest end of a prefix that some piece begins with: the pieces that end there, and the states that further characters lead to."""

    __slots__ = ("ends", "forward", "key")

    def __init__(self, forward: SharedForward, key: str) -> None:
        self.forward, self.key, self.ends = forward, key, forward._ends(key) if key else ()

    def __missing__(self, character: str) -> State:
        forward, key = self.forward, self.key + character
        forward.n_kept += 1
        while key not in forward.begun:
            key = key[1:]
        if key not in forward.states:
            forward.states[key] = State(forward, key)
        value = self[character] = forward.states[key]
        return value


class SharedForward:
    """Encodes sorted words, keeping the forward table of the common prefix."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.merges = model, model.kind == "bpe"
        self.pieces = model.rank or model.ids
        #: What pieces begin with.
        self.begun = {p[:n] for p in self.pieces for n in range(len(p) + 1)} | {""}
        self.states: dict[str, State] = {}
        self.follows = Follows(self)
        #: Steps of the automaton and pairs of pieces that are kept.
        self.n_kept = 0
        #: What a character adds that a unigram model doesn't have.
        self.unknown = min(model.score.values(), default=0.0) - 10.0

    def _ends(self, key: str) -> tuple[tuple[int, str], ...]:
        """The pieces that these characters end with, from long to short, after their lengths."""
        return tuple((len(key) - k, key[k:]) for k in range(len(key)) if key[k:] in self.pieces)

    def _start(self) -> State:
        """The state of the empty prefix. What is kept beyond the limit goes; what lies along the last word's prefixes lives on with them."""
        if self.n_kept > FOLLOWERS:
            self.states.clear()
            self.follows.clear()
            self.n_kept = 0
        if "" not in self.states:
            self.states[""] = State(self, "")
        return self.states[""]

    def walk(self, words: Iterable[str]) -> Iterator[list[str]]:
        """Pieces of each word; words are sorted, so the walk is depth-first and each prefix is extended once."""
        return self._walk_merges(words) if self.merges else self._walk_scores(words)

    def _walk_merges(self, words: Iterable[str]) -> Iterator[list[str]]:
        """Of a BPE model: a prefix that can be reached at all has score 0, so its last piece is the first that leaves its seam open."""
        follows = self.follows
        states, adds = [self._start()], [follows[""]]  # of each prefix: its state, and the piece that ends the way to it with which ones may come next
        was = ""
        for word in words:
            shared = _shared(was, word)
            del states[shared + 1 :], adds[shared + 1 :]
            was, state = word, states[shared]
            for character in word[shared:]:
                state = state[character]
                for n, piece in state.ends:
                    if adds[-n][piece]:
                        break
                else:
                    piece = character
                states.append(state)
                adds.append(follows[piece])
            found, end = [], len(word)
            while end:
                last = adds[end]
                found.append(last.piece)
                end -= last.size
            found.reverse()
            yield found
            if self.n_kept > FOLLOWERS:
                states[0], adds[0] = self._start(), follows[""]

    def _walk_scores(self, words: Iterable[str]) -> Iterator[list[str]]:
        """Of a unigram model: pieces add their own scores."""
        scores, states = self.model.score, [self._start()]
        best, last = [0.0], [""]  # of each prefix: the best score, and the piece that ends the way to it
        was = ""
        for word in words:
            shared = _shared(was, word)
            del states[shared + 1 :], best[shared + 1 :], last[shared + 1 :]
            was, state = word, states[shared]
            for character in word[shared:]:
                state = state[character]
                top, chosen = -math.inf, ""
                for n, piece in state.ends:
                    score = scores[piece] + best[-n]
                    if score > top:
                        top, chosen = score, piece
                if not chosen:
                    top, chosen = best[-1] + self.unknown, character
                states.append(state)
                best.append(top)
                last.append(chosen)
            found, end = [], len(word)
            while end:
                found.append(last[end])
                end -= len(found[-1])
            yield found[::-1]
            if self.n_kept > FOLLOWERS:
                states[0] = self._start()


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n, limit = 0, min(len(a), len(b))
    while n < limit and a[n] == b[n]:
        n += 1
    return n


class Encoder:
    """Ids of whole texts, with the distinct marked words of many texts worked out together."""

    def __init__(self, model: PieceModel, cache: int = CACHE_CHARS) -> None:
        self.model, self.cache = model, cache
        self.known_blanks: dict[int, list[int]] = {}
        self.forward = SharedForward(model)
        self.kinds = np.full(0x110000, _ALONE if model.byte_ids else _BLANK + 1, np.uint16)
        if model.byte_ids:
            self.kinds[list(map(ord, model.kinds))] = list(model.kinds.values())
        self.kinds[ord(MARK)] = _BLANK
        self._fresh()

    def _fresh(self) -> None:
        self.place: dict[str, int] = {}
        self.offsets, self.values, self.chars = np.zeros(1, np.int64), np.empty(0, np.int32), 0

    def cut(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Words of all texts one after another, as places in a list of distinct ones; that list; where each text's begin and end.

        A word is a run of marks, where there is one, and characters that pieces join. A model without pieces for bytes
        makes one unknown of a run of characters, so there only blanks cut.
        """
        if self.model.squeeze:
            texts = [" ".join(x for x in (t or "").split(" ") if x) for t in texts]
        lead = MARK if self.model.prefix else ""
        marked = [lead + t if t else "" for t in texts]
        starts = np.r_[0, np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))]
        whole = "".join(marked).replace(" ", MARK)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.kinds[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = (kind[:-1] != _BLANK) & ((kind[1:] != kind[:-1]) | (kind[1:] == _ALONE))
        begins[starts[:-1][np.diff(starts) > 0]] = True
        size = (codes > 0x7F).astype(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF)  # bytes beyond the first
        first = np.flatnonzero(begins)
        at = np.r_[first + (np.cumsum(size, dtype=np.int64) - size)[first], len(codes) + int(size.sum(dtype=np.int64))]
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(whole.encode())).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary.to_pylist(), np.searchsorted(first, starts)

    def _learn(self, words: set[str]) -> None:
        made, sizes, ids_of = [], [], self.model.ids.get
        merges, several = self.model.kind == "bpe", MARK + MARK
        # merges of blanks come last, so the walk is over words with one mark at most
        odd = sorted(w for w in words if w[:2] == several or w == MARK) if merges else []
        plain = sorted(words.difference(odd) if odd else words)
        for found in self.forward.walk(plain):
            before = len(made)
            ids = list(map(ids_of, found))
            if None in ids:
                self._spell(found, made)
            else:
                made += ids
            sizes.append(len(made) - before)
        bare = [w.lstrip(MARK) for w in odd]
        for word, found in zip(odd, self.forward.walk(MARK + x if x else "" for x in bare), strict=True):
            before, run = len(made), len(word) - len(word.lstrip(MARK))
            alone = bool(found) and found[0] == MARK
            made += blanks(self.model, run - (1 if found and not alone else 0), self.known_blanks)
            self._spell(found[alone:], made)
            sizes.append(len(made) - before)
        first = len(self.place)
        self.place.update(zip(plain + odd, range(first, first + len(sizes)), strict=True))
        self.chars += sum(map(len, words))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes, dtype=np.int64)))
        self.values = np.concatenate((self.values, np.array(made, np.int32)))

    def _spell(self, pieces: list[str], made: list[int]) -> None:
        """Adds the ids of pieces; a run of characters that the model has no bytes for is one unknown."""
        first = len(made)
        for piece in pieces:
            own = self.model.ids.get(piece)
            if own is not None:
                made.append(own)
            elif self.model.byte_ids or len(made) == first or made[-1] != self.model.unknown:
                made += _ids(self.model, piece)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and end."""
        if self.chars > self.cache:
            self._fresh()
        groups, start = [], 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held < GROUP_CHARS):
                held += len(texts[stop] or "")
                stop += 1
            groups.append(self.cut(texts[start:stop]))
            start = stop
        fresh = {w for _, words, _ in groups for w in words if w not in self.place}
        if fresh:
            self._learn(fresh)
        values, bounds = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for places, words, starts in groups:
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            begin, n = self.offsets[at][places], (self.offsets[at + 1] - self.offsets[at])[places]
            ends = np.r_[0, np.cumsum(n)]
            values.append(self.values[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)])
            bounds.append(bounds[-1][-1] + ends[starts[1:]])
        return np.concatenate(values), np.concatenate(bounds)


def decode(model: PieceModel, ids: list[int]) -> str:
    """Text of ids; ids outside the vocabulary give nothing, broken UTF-8 among byte pieces the replacement character."""
    shown, n = model.bytes_of, len(model.bytes_of)
    text = b"".join([shown[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def decode_all(model: PieceModel, ids: np.ndarray, bounds: np.ndarray, shown: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of many arrays of ids, one after another; shown and first are the bytes of all pieces and where each begins.

    Where byte pieces make no UTF-8 the texts are decoded one by one, as decode() does it.
    """
    n = len(first) - 1
    known = np.where((ids >= 0) & (ids < n), ids, n)  # the last one is empty
    begin, size = np.r_[first, first[-1]][known], np.r_[np.diff(first), 0][known]
    ends = np.cumsum(size)
    data = shown[np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - size, size) + np.repeat(begin, size)]
    at = np.r_[0, ends][bounds]
    inner = at[:-1][at[:-1] < len(data)]
    try:
        data.tobytes().decode()
        whole = not (data[inner] & 0xC0 == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if not whole or model.prefix:
        return pa.array([decode(model, ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


#: Characters of texts that are cut together, ids that are decoded together.
GROUP_CHARS, GROUP_IDS = 1_500_000, 400_000


def encoded(text: Column, model: PieceModel, cache: int = CACHE_CHARS) -> Column:
    """Ids of each whole text; null gives an empty array. cache: characters of distinct words that a task keeps."""

    @F.arrow_udf("array<int>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model, cache)
        for batch in batches:
            flat, bounds = encoder.encode(batch.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            pa.default_memory_pool().release_unused()

    return apply(text)


def decoded(ids: Column, model: PieceModel) -> Column:
    """Text of each array of ids; null gives null."""

    @F.arrow_udf("string")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shown = np.frombuffer(b"".join(model.bytes_of), np.uint8)
        first = np.r_[0, np.cumsum([len(x) for x in model.bytes_of])]
        for batch in batches:
            ends, values = batch.offsets.to_numpy().astype(np.int64), batch.values.fill_null(-1).to_numpy()
            parts, start = [], 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + GROUP_IDS, "right")) - 1)
                parts.append(decode_all(model, values[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start], shown, first))
                start = stop
            texts = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            del parts, values
            yield pc.if_else(batch.is_valid(), texts, None) if batch.null_count else texts
            pa.default_memory_pool().release_unused()

    return apply(ids)


def encode_documents(docs: DataFrame, model_path: str = MODEL, text: str = "text", cache: int = CACHE_CHARS) -> DataFrame:
    """docs with the column piece_ids (array<int>), one row per input row; a column of that name is replaced.

    Null and empty texts give an empty array. A text that holds the mark itself (U+2581) reads back with a blank in its
    place, as with the model's own library. Repeated rows stay, an empty table gives an empty one.
    """
    return narrow_batches(docs).withColumn("piece_ids", encoded(F.col(text), load_model(model_path), cache))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_documents(docs)
    back = decoded(F.col("piece_ids"), load_model(MODEL))
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", (back == F.coalesce("text", F.lit(""))).alias("round_trip"))
