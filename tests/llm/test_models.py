"""Language identification, toxicity, secrets, licences, search and pieces."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from foliospark.llm import langid, licenses, pieces, topk, toxicity
from foliospark.llm.common import bounded_sample
from foliospark.llm.license_texts import TEMPLATES

SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch enk ölt urg ist".split(), "cc": "qui eau oir ent ais".split()}


def made_text(lang, rng, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, made_text(lang, rng, 3 + i % 60), lang, 1.0) for i, lang in enumerate("aa bb cc".split() * 60)]
    rows += [(900, None, "aa", 1.0), (901, "12 34 !!", "bb", 1.0), (902, "", None, 1.0), (903, made_text("bb", rng), None, 1.0), (904, "x" * 50_000, "aa", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.identify(df, df.where("doc_id % 4 <> 2")).collect()}
    held = [(i, lang) for i, _, lang, _ in rows[:180] if i % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(df.limit(5), df, min_margin=0.99).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(df.limit(5), df.limit(0)).collect()} == {"und"}
    assert langid.identify(df.limit(0), df).count() == 0


def test_groups_of_copies_are_learned(spark):
    """Many copies of few texts keep their language; copies count once."""
    rng = random.Random(2)
    few, many = [made_text("aa", rng, 20) for _ in range(3)], [made_text("bb", rng, 20) for _ in range(3000)]
    df = spark.createDataFrame([(i, few[i % 3], "aa") for i in range(30_000)] + [(i, t, "bb") for i, t in enumerate(many)] + [(0, "x", None)], "doc_id long, text string, lang string")
    found = langid.training_passages(df, sample_docs=50)
    assert sorted(found) == ["aa", "bb"] and all(langid.plain(t).strip() in found["aa"] for t in few) and len(found["aa"]) < 4 * len(langid.plain(few[0]))
    rows = df.where("lang is not null").withColumn("h", F.xxhash64("text"))
    taken = bounded_sample(rows.select("lang", "text", "h"), "lang", "h", 50).collect()
    assert sorted(Counter(r["lang"] for r in taken).items()) == [("aa", 3), ("bb", 50)]
    again = bounded_sample(rows.select("lang", "text", "h").repartition(7), "lang", "h", 50).collect()
    assert sorted(taken) == sorted(again)
    with pytest.raises(ValueError):
        bounded_sample(rows.select("lang", "text", "h"), "text", "h", 50, most_groups=10)


def test_training_rows(spark):
    docs = spark.createDataFrame([(1, "b", 0), (1, "a", 0), (1, "a", 0), (2, None, 0), (3, "x" * 30, 0), (4, "y", 0), (None, "z", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (None, 1), (9, 0), (4, None)], "doc_id long, toxic int")
    got = [tuple(r[c] for c in ("doc_id", "text", "toxic")) for r in toxicity.training_rows(docs, labels, sample_chars=20)]
    assert [(i, y) for i, _, y in got] == [(1, 0), (1, 1), (4, 1)] and got[0][1] == got[1][1]


def test_gradient():
    texts = [b" one two three ", b" four five six seven " * 9]
    words = toxicity.words_of(texts)
    starts, lengths, owner = toxicity.window_starts(words.first_word)
    w = {k: v.astype(np.float64) for k, v in toxicity.fresh_weights(2).items()}
    y = np.array([1.0, 0.0])[owner]

    def loss():
        z = toxicity.forward(w, toxicity.embedded(w, words), starts, lengths).astype(float)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    logit, saved = toxicity.forward(w, toxicity.embedded(w, words), starts, lengths, keep=True)
    grad = toxicity.backward(w, words, np.ones(len(words.word)), saved, 1 / (1 + np.exp(-logit)) - y)
    rng = np.random.default_rng(0)
    for name in w:
        flat, g = w[name].reshape(-1), grad[name].reshape(-1)
        places = rng.choice(np.flatnonzero(g) if name in ("word", "gram") else len(flat), 4)
        for i in places:
            was = flat[i]
            flat[i] = was + 1e-2
            up = loss()
            flat[i] = was - 1e-2
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-2 - g[i]) < 2e-2 + 0.05 * abs(g[i]), (name, i)


def test_toxicity_of_one_class():
    for texts, labels, low in (([], [], True), (["a b"] * 3, [0] * 3, True), (["a b"] * 300, [1] * 300, False)):
        assert (toxicity.scores(toxicity.train(texts, labels), ["one two", "c"]) < 0.5).all() == low


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 36, 37, 100):
        starts, lengths, _ = toxicity.window_starts(np.array([0, n]))
        covered = {w for s, k in zip(starts, lengths, strict=True) for w in range(s, s + k)}
        assert covered == set(range(n)) and (not n or starts.max() + lengths[-1] == n)


def test_toxicity_learns(spark):
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "kalotu" for b in "emi" for c in ("r", "sten", "")]

    def text(bad):
        parts = rng.choices(words, k=rng.randrange(20, 150))
        for _ in range(3 if bad else 0):
            parts[rng.randrange(len(parts))] = "vile" + rng.choice(words)
        return " ".join(parts)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(1000, None, 0.0), (1001, "", 0.0), (1002, "...", 0.0), (1003, "a " * 3_000_00, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(None, 1), (3, None)], "doc_id long, toxic int")
    weights = toxicity.fitted(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, weights).collect()}
    held = [(i, y) for i, _, y in rows if i % 5 == 0]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.9 * len(held)
    assert [got[i]["score"] for i in (1000, 1001, 1002)] == [0, 0, 0] and 0 <= got[1003]["score"] <= 1
    assert toxicity.score_documents(docs.limit(0), weights).count() == 0
    alone = toxicity.scores(weights, [rows[8][1]])
    assert abs(alone[0] - got[8]["score"]) < 1e-6  # neighbours in a batch don't matter


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1]) if x != y else last + 1
    return row[-1]


FILL = "é lorem ipsum dolor sit amet of the and in to with word software under use".split()


def test_license_matches(spark):
    """Whole templates among other words are found with exact spans; what is reported never exceeds the longest common subsequence."""
    rng, index = random.Random(2), licenses.Index(TEMPLATES)
    for n, (code, _, text) in enumerate(TEMPLATES):
        doc = " ".join(["é lorem"] * 30 + [text] + ["ipsum"] * 20)
        found = licenses.matches_of(doc.encode(), index)
        best = [m for m in found if m["license"] == code and m["coverage"] == 1]
        assert best and doc[best[0]["begin"] : best[0]["end"]] in text, (code, text)
        assert len(found) == 1 or all(a["end"] <= b["begin"] for a, b in zip(found[:-1], found[1:], strict=True))
        words = [w if rng.random() > 0.1 else "odd" for w in text.split()]
        tokens, body = licenses.words_of(" ".join(words).encode())[0].tolist(), index.templates[n].words.tolist()
        for m in licenses.matches_of(" ".join(words).encode(), index):
            if (m["license"], TEMPLATES[n][0]) == (code, m["license"]) and m["template"] == TEMPLATES[n][1]:
                assert m["matched"] <= lcs(body, tokens) and m["coverage"] >= 0.8


def test_license_recall_at_the_threshold():
    """Templates with as many words replaced, left out and put in as a coverage of 0.8 allows, telling words left alone."""
    rng, index = random.Random(3), licenses.Index(TEMPLATES)
    found = total = 0
    for n, (code, _, text) in enumerate(TEMPLATES):
        template = index.templates[n]
        for _ in range(4):
            words, tokens = text.split(), len(template.words)
            for _ in range(int(0.2 * tokens) if tokens < 10 else rng.randrange(int(0.1 * tokens), int(0.2 * tokens) + 1)):
                i, kind = rng.randrange(len(words)), rng.randrange(3)
                words[i : i + (kind < 2)] = [rng.choice(FILL)] if kind else []
            doc = " ".join(rng.choices(FILL, k=30) + words + rng.choices(FILL, k=30))
            kept = Counter(licenses.words_of(" ".join(words).encode())[0].tolist())
            # brute force: coverage of the best alignment is at least that of the longest common subsequence
            same = lcs(template.words.tolist(), licenses.words_of(" ".join(words).encode())[0].tolist())
            columns = len(template.words) + sum(kept.values()) - same
            telling = Counter(template.words[template.telling].tolist())
            if same >= 0.8 * columns and not telling - kept:
                total += 1
                found += code in {m["license"] for m in licenses.matches_of(doc.encode(), index)}
    print(f"recall {found / total:.3f} of {total}")
    assert total > 300 and found >= 0.95 * total


@pytest.mark.parametrize(("text", "code"), [
    ("Released under our MIT License.", "MIT"), ("Licensed under XX BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    (dict((t[0], t[2]) for t in TEMPLATES if t[1] == "header")["GPL-2.0"], "GPL-2.0"), (dict((t[0], t[2]) for t in TEMPLATES if t[1] == "header")["LGPL-3.0"], "LGPL-3.0"),
    ("GNU General Public License, version 9", None), ("This work is licensed under CC BY 7.5.", None),
])
def test_telling_words(text, code):
    found = {m["license"] for m in licenses.matches_of(f"one two {text} three four".encode(), licenses.Index(TEMPLATES))}
    assert found == ({code} if code else set())


def test_whole_long_licence_from_a_table(spark, monkeypatch):
    """A text of five thousand words, one of eleven left out, and the number of alignments of texts that repeat themselves."""
    rnd = random.Random(1)
    words = [f"w{int(3000 * rnd.random() ** 2)}" for _ in range(5000)]
    templates = spark.createDataFrame([("LONG-1.0", "whole", " ".join(words)), ("NONE", "empty", None)], "license string, template string, text string")
    text = "intro " * 50 + " ".join(w for i, w in enumerate(words) if i % 11) + " tail" * 30
    found = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, " ".join(words[:2500]))], "doc_id int, text string"), templates).collect()
    assert [(r["doc_id"], r["license"], r["matched"], r["begin"]) for r in found] == [(1, "LONG-1.0", 4545, 300)]
    assert text[found[0]["begin"] : found[0]["end"]].split() == [w for i, w in enumerate(words) if i % 11]
    own = next(t for c, _, t in licenses.TEMPLATES if c == "BSD-3-Clause" and len(t) > 800)
    index, n, plain = licenses.Index(licenses.TEMPLATES), [], licenses.align
    monkeypatch.setattr(licenses, "align", lambda *a: n.append(1) or plain(*a))
    assert len(licenses.matches_of("\n".join(f"file {i} zz{i} {own}" for i in range(8)).encode(), index)) == 8 and len(n) < 60
    n.clear()
    assert len(licenses.matches_of(own.encode(), index)) == 1 and len(licenses.matches_of(own.encode(), index)) == 1 and len(n) < 10
    n.clear()
    near = " ".join(w if rnd.random() < 0.76 else "zz" for w in own.split())
    assert not licenses.matches_of(" ".join([near] * 3).encode(), index) and len(n) < 40


def test_words_within_a_band():
    rng = np.random.default_rng(0)
    for _ in range(500):
        t, x = (rng.integers(0, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64))
        d, b = int(rng.integers(-8, 30)), int(rng.integers(1, 5))
        assert licenses.in_band(t, x, d, b).tolist() == [any(0 <= i + d + k < len(x) and x[i + d + k] == t[i] for k in range(-b, b + 1)) for i in range(len(t))]


def test_license_rows(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BLOCK", 50)  # words are cut between blocks
    rows = [(1, "Released under the MIT License. " * 3, "x"), (2, None, "x"), (3, "", "x"), (4, "word", "x"), (None, "released under the mit license", "x"), (5, "Nothing of that kind. " * 5000, "x"), (5, "x" * 500, "x"), (6, "Released under the MIT License.", "x"), (6, "Released under the MIT License.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = Counter(r["doc_id"] for r in licenses.scan_licenses(df).where("license = 'MIT'").collect())
    assert got == {1: 3, None: 1, 6: 2}
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    words, begins, ends = licenses.words_of(rows[5][1].encode())
    assert len(words) == 20_000 and [rows[5][1][a:b].lower() for a, b in zip(begins[:5].tolist(), ends[:5].tolist(), strict=True)] == ["nothing", "of", "that", "kind", "nothing"]
    with pytest.raises(ValueError):
        licenses.Index([("a", "b", "c d e " * 3000)])


@pytest.mark.parametrize("scale", [0.3, 0.004])
def test_top_k_is_exact(spark, scale):
    rng = np.random.default_rng(9)
    x = rng.normal(0, scale, (900, 6))
    x[100:400] = x[5]  # one vector that a third of the rows share
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 6, 1), (2150, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (2200, [0.5, 0.5], 1), (2250, [], 1), rows[7], rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = {i: np.floor(256 * np.array([*v, *[0.0] * (6 - len(v))])).astype(int) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    assert sorted(got) == sorted(i for i in whole if i % 50 == 0)
    for q, found in got.items():
        want = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        assert [found[k] for k in range(1, 6)] == [(i, -s) for s, i in want]
    few = topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("large", [3e6, 5e6])
def test_top_k_of_large_components(spark, large):
    """Scores beyond what floats hold (and, at 5e6 * 256, near the end of 64 bits), with ties."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-large, large, (300, 4))
    x[20:30], x[40] = x[10], np.array([large] * 4)
    df = spark.createDataFrame([(i, v.tolist(), "a", 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, query_id string, score int")
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in enumerate(x.tolist())}
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 300, 10):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, -s) for s, i in want]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e8] * 4), (1, [1.0] * 4)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)


def test_search_in_several_blocks(spark, monkeypatch):
    """Blocks of vectors and of queries smaller than cells, so that cells and query blocks are split."""
    for name, n in (("BLOCK", 16), ("QUERIES", 8), ("ANNULUS", 4), ("SAMPLE", 20)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.05, (90, 3)) for c in ([0, 0, 1], [0, 1, 0], [1, 0, 0], [0.6, 0.6, 0])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * x).astype(int)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 4 == 0).collect()}
    for q in range(0, 360, 4):
        want = sorted((-int(whole[q] @ whole[i]), i) for i in range(360) if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, -s) for s, i in want]


def odd_texts():
    rng = random.Random(5)
    letters = "aaeett \n\t  ▁éß你🙂ABC.,'0123 thinger"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", " " * 37, "a" + " " * 16 + "b", "x" * 3000, "  Hello   world \x00"]


def test_pieces_as_the_library_gives_them():
    model, lib, texts = pieces.load_model(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), odd_texts()
    encoder = pieces.Encoder(model)
    for part in (texts[:1000], texts[1000:]):
        ids, bounds = encoder.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == lib.encode(part, num_threads=1)
    assert all(pieces.decode(model, lib.encode(t)) == t.replace("▁", " ") == lib.decode(lib.encode(t)) for t in texts)


def test_unigram_is_viterbi():
    proto, rng = pb.ModelProto.FromString(open(pieces.MODEL, "rb").read()), random.Random(3)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -10 - 5 * rng.random() + 1.5 * min(len(p.piece), 6)
    model, lib = pieces.model_of(proto), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = odd_texts()[:500]
    ids, bounds = pieces.Encoder(model).encode(texts)
    score = {i: p.score for i, p in enumerate(proto.pieces)}
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        mine, theirs = ids[a:b].tolist(), lib.encode(t)
        assert mine == theirs or abs(sum(map(score.get, mine)) - sum(map(score.get, theirs))) < 1e-3  # a tie


def test_prefixes_are_shared():
    """Each node of the trie is extended once."""
    forward = pieces.SharedForward(pieces.load_model())
    calls = []
    known = forward._ends
    forward._ends = lambda key: (calls.append(key), known(key))[1]
    words = sorted(f"▁prefix{a}{b}" for a in "abcd" for b in "xyz")
    made = list(forward.walk(words))
    assert ["".join(p) for p in made] == words
    assert made == [next(pieces.SharedForward(forward.model).walk([w])) for w in words]
    assert len(calls) <= len({w[:n] for w in words for n in range(1, len(w) + 1)})


def test_words_are_cut_where_no_piece_joins():
    """Signs and lines that follow a word don't make it another one to walk."""
    encoder = pieces.Encoder(pieces.load_model())
    texts = [f"{a}{sign}{b} {n}" for a in ("house", "été", "тест") for b in ("Day", "取获一个x", "42") for sign in (".", "!!", ",\n", "\n\n", "$$$", "7") for n in range(10, 30)]
    ids, bounds = encoder.encode(texts)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == lib.encode(texts, num_threads=1)
    assert len(encoder.place) <= 40 and len(encoder.forward.states) < 200


@pytest.mark.parametrize("kind", [1, 2])
def test_runs_without_pieces_for_bytes_are_one_unknown(kind):
    proto = pb.ModelProto.FromString(open(pieces.MODEL, "rb").read())
    kept = [p for p in proto.pieces if p.type != 6]
    del proto.pieces[:]
    proto.pieces.extend(kept)
    proto.trainer_spec.byte_fallback, proto.trainer_spec.model_type = False, kind
    lib, encoder = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.Encoder(pieces.model_of(proto))
    texts = ["a\n\n🦖🦖b", "🦖", "x🦖\n y", "1\n2"]
    ids, bounds = encoder.encode(texts)
    mine = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [[i for i in x if i == encoder.model.unknown] for x in mine] == [[i for i in x if i == encoder.model.unknown] for x in lib.encode(texts)]
    assert mine == lib.encode(texts) or kind == 1


def test_encode_documents(spark):
    rows = [(1, "Hello world", 0), (2, None, 0), (3, "", 0), (4, "a▁b", 0), (5, "word " * 20_000, 0), (5, "word " * 20_000, 0), (None, "é🙂\n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids int")
    model = pieces.load_model()
    out = pieces.encode_documents(df).withColumn("back", pieces.decoded(F.col("piece_ids"), model)).collect()
    assert [r["back"] for r in out] == [(t or "").replace("▁", " ") for _, t, _ in rows]
    assert pieces.encode_documents(df.limit(0)).count() == 0
    broken = spark.createDataFrame([([3 + 0xE4],), ([-1, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in broken.select(pieces.decoded(F.col("ids"), model)).collect()] == ["�", "", None, ""]
