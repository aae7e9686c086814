"""The near-dedup stage against brute force over word sets."""

import random
from itertools import combinations

import corpus_pipeline

from foliospark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a: str, b: str) -> float:
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def kept(rows) -> list:
    """Ids that stay, by union of all pairs at 0.8 or more."""
    root = {i: i for i, _ in rows}
    for (i, a), (j, b) in combinations(rows, 2):
        if similarity(a, b) >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    return sorted(set(root.values()))


def planted() -> list:
    rnd = random.Random(3)
    rows = []

    def changed(words, n):
        words = list(words)
        for i in rnd.sample(range(5, len(words) - 5), n):
            words[i] = f"x{rnd.randrange(10**6)}"
        return words

    for _ in range(40):
        base = [f"w{rnd.randrange(10**5)}" for _ in range(rnd.randrange(120, 240))]
        rows += [base, changed(base, 2), changed(base, 3), changed(base, 5), base[:-8] + changed(base, 1)[-8:]]
    chain = [f"c{rnd.randrange(10**5)}" for _ in range(200)]  # each is close to the last, not to the first
    for _ in range(12):
        rows.append(chain)
        chain = chain[15:] + [f"c{rnd.randrange(10**5)}" for _ in range(15)]
    rows = [" ".join(r) for r in rows]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_stage_is_jaccard(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == kept(rows)
    wide = [1 for (_, a), (_, b) in combinations(rows, 2) if similarity(a, b) >= 0.8 and (simhash.fingerprint_of(a.encode()) ^ simhash.fingerprint_of(b.encode())).bit_count() > 4]
    assert len(wide) > 10  # pairs that four bits miss


def test_rows_without_id(spark):
    base = [f"w{i}" for i in range(100)]
    near, far = " ".join(base[:97] + ["a", "b", "c"]), " ".join(base[:50])
    rows = [(None, " ".join(base), "en", "s", 1), (None, near, "en", "s", 1), (None, far, "en", "s", 1), (7, far + " y", "en", "s", 1), (None, None, "en", "s", 0), (None, " ", "en", "s", 1)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted([("7", far + " y"), ("None", min(" ".join(base), near)), ("None", "None")])
