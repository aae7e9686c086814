"""Secret scan: placements of real key shapes, look-alikes, held-out findings, long texts."""

import random
import re
import string
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.llm import secret_scan
from foliospark.llm.findings import labelled_findings


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.train(labelled_findings(spark))


HEX, ISSUED = "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "AKIA" + "QWERTYUIOP234567"
LETTERS, MARKS = "qWvKzXjRgTbNmPlHsDfYcQaZ", "S3cr3t!pass#2024xyz"
PLACED = {
    f"see https://api.example.com/v1?api_key={HEX} there": {HEX}, f"see token={HEX}&x=y there": {HEX}, f'see {{"user":"bob","api_key":"{HEX}","n":1}} there': {HEX},
    f"see postgres://admin:{HEX}@db:5432/x there": {HEX}, f"see user=bob;password={HEX};x=1 there": {HEX}, f"see key={ISSUED},secret={HEX[::-1]},n=1 there": {ISSUED, HEX[::-1]},
    f"see <b>{ISSUED}</b> there": {ISSUED}, f"see {'a_very_long_' * 5}api_key={HEX} there": {HEX}, f"see api_key={LETTERS} there": {LETTERS}, f"see password={MARKS} there": {MARKS},
    f"see --password={LETTERS} there": {LETTERS}, f'see password = "{MARKS}" there': {MARKS}, f"one,{ISSUED}": {ISSUED}, f"f({ISSUED})": {ISSUED}, f"Bearer;{ISSUED}": {ISSUED},
    f"key\u00a0{ISSUED}\u00a0here": {ISSUED}, f"Authorization: Bearer {HEX}": {HEX}, f"the token is {HEX}.": {HEX}, f"password={HEX}...": {HEX}, f"key 🙂 = '{ISSUED}'": {ISSUED},
    "the password: required, a token=undefined and access:something": set(), f"see commit={HEX}9f8e7d6c;file=build/output/v1.2.3/main.o there": set(),
    f"commit {HEX}f962abcd fixes build/output/v1.2.3/main.o and 4785380592391139": set(), "password=example_password_12": set(), "no candidates at all " * 3000: set(), "": set(),
}


def test_placements(spark, model):
    texts = list(PLACED)
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").repartition(1)
    got = {i: set() for i in range(len(texts))}
    for r in secret_scan.scan(df, model).collect():
        assert texts[r["doc_id"]][r["begin"] : r["end"]] == r["value"]
        if r["is_secret"]:
            got[r["doc_id"]].add(r["value"])
    assert got == {i: PLACED[t] for i, t in enumerate(texts)}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(df, model).collect()}
    for i, text in enumerate(texts):
        want = text
        for v in PLACED[text]:
            want = want.replace(v, "[SECRET]")
        assert clean[i] == want
    assert clean[99] is None


def test_only_the_place_itself_is_redacted(spark, model):
    text = f"password={HEX} fixed in commit {HEX} of revision {HEX[:6]}"
    out = secret_scan.redacted(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).first()["text"]
    assert out == text.replace(f"password={HEX}", "password=[SECRET]")


def test_rows_and_columns(spark, model):
    rows = [(1, f"x {ISSUED}", 9, "p", "q"), (1, f"x {ISSUED}", 9, "p", "q"), (None, f"x {ISSUED}", None, None, "q"), (2, None, None, "p", None), (3, "", 0, "p", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, parts string, judged string")
    found = secret_scan.scan(df, model)
    assert Counter((r["doc_id"], r["value"]) for r in found.where("is_secret = 1").collect()) == {(1, ISSUED): 2, (None, ISSUED): 1}
    out = secret_scan.redacted(df, model)
    assert out.columns == df.columns
    assert Counter(map(tuple, out.collect())) == Counter([(i, t and t.replace(ISSUED, "[SECRET]"), n if not t else 10, *rest) for i, t, n, *rest in rows])
    assert secret_scan.scan(df.limit(0), model).count() == 0 and secret_scan.redacted(df.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, f"a\ufdd0b token={HEX}")], "doc_id int, text string")
    assert [r["value"] for r in secret_scan.scan(odd, model).collect()] == [HEX]


def test_no_python_runs(spark, model):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for plan in (secret_scan.scan(df, model), secret_scan.redacted(df, model)):
        assert "Python" not in plan._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", "")


def test_long_texts(spark, model):
    """Texts that would take hours by a pattern whose time grows with the square of a run."""
    n = 40_000
    texts = ["a1" + "." * n + ",x", "password=" + "a." * n, "a=1" * n, "token " * n, "x" * n * 5, f"k={HEX}, " * (n // 20), "a-b" * n + "=", "://" * n, "9" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    secret_scan.scan(df, model).count()
    began = time.perf_counter()
    found = Counter(r["doc_id"] for r in secret_scan.scan(df, model).select("doc_id").collect())
    assert time.perf_counter() - began < 60 and found[5] == n // 20 and found[8] == 1


def held_out(n=400):
    """Findings written independently of the rules that the model learns from: (text, value, label)."""
    rng = random.Random(8)

    def of(chars, k):
        return "".join(rng.choice(chars) for _ in range(k))

    words = "invoice customer shipped harbour window table green river market kitchen report garden signal engine bottle".split()
    base = string.ascii_letters + string.digits
    out = []
    for _ in range(n):
        prose = " ".join(rng.choices(words, k=6))
        kind = rng.randrange(12)
        value, frame = [
            (of(base, 43), "client_secret: {}"), (of("0123456789abcdef", 64), "SECRET_KEY='{}'"), (of(base, 20) + "/" + of(base, 19), 'aws_secret_access_key = "{}"'), ("sk_live_" + of(base, 24), "stripe {} in use"),
            ("ghp_" + of(base, 36), "git clone with {}"), (rng.choice(words).title() + of("0123456789", 4) + rng.choice("!#%") + of(base, 6), "login bob, password: {}"),
            (of("0123456789abcdef", 40), "merged in commit {} yesterday"), ("-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), "request_id={} done"), ("/".join(rng.choices(words, k=3)) + f"/v{rng.randrange(9)}.{rng.randrange(9)}.js", "loads {} first"),
            (of("0123456789", 16), "card number {} declined"), ("_".join(rng.choices(words, k=3)) + of("0123456789", 2), "calls {} twice"), (rng.choice(["your_password_here", "changeme123456", "<insert-token>", "process.env.API_TOKEN", "undefined", "not-a-real-key-1"]), "api_token = {}"),
        ][kind]
        out.append((f"{prose} {frame.format(value)} {prose}", value, int(kind < 6)))
    return out


def test_precision_and_recall_on_held_out_findings(spark, model):
    rows = held_out()
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id int, text string").repartition(4)
    said = {(r["doc_id"], r["value"]) for r in secret_scan.scan(df, model).where("is_secret = 1").collect()}
    true = {(i, v) for i, (_, v, y) in enumerate(rows) if y}
    precision, recall = len(said & true) / len(said), len(said & true) / len(true)
    print(f"precision {precision:.3f}, recall {recall:.3f} of {len(true)} secrets and {len(rows) - len(true)} look-alikes")
    assert precision >= 0.9 and recall >= 0.9


def test_training_needs_no_complete_rows(spark):
    rows = [(None, None, None, None, 1), ("a", None, "b", None, None), *[("token=", HEX[i:] + HEX, None, "", 1) for i in range(20)], *[("file ", f"build/v{i}/main.o", "", None, 0) for i in range(20)]]
    trained = secret_scan.train(spark.createDataFrame(rows, "left string, value string, right string, path string, label int"), words=["build", "main"])
    df = spark.createDataFrame([(1, f"x token={HEX[::-1]} y"), (2, "x build/v123/main.o y")], "doc_id int, text string")
    assert {r["doc_id"]: r["is_secret"] for r in secret_scan.scan(df, trained).collect()} == {1: 1, 2: 0}


def plain_features(value, left, right, path, model):
    """A candidate's features, read character by character."""
    order = "abcdefghijklmnopqrstuvwxyz0123456789A+/-"

    def mean(slots, levels):
        return (sum(levels[i] for i in slots) / len(slots) - 64) / 16 if slots else 0.0

    def slots(text):
        return [zlib.crc32(w.encode()) % secret_scan.WORD_SLOTS for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 1]

    def known(word):
        slot = zlib.crc32(word.lower().encode()) >> (32 - secret_scan.DICTIONARY_BITS)
        return model.dictionary[slot >> 3] >> (slot & 7) & 1

    kind = [order.index(c) if c in order[:36] + "+/" else 36 if "A" <= c <= "Z" else 39 for c in value]
    blank = r"[\s ]"
    name = re.search(rf"([\w.-]*){blank}{{0,3}}[\"']?{blank}{{0,3}}(?:=>|:=|=|:)?{blank}{{0,3}}[\"'`(\[{{<]?$", left).group(1)
    near, n = left + " " + right, len(value)
    assigned = re.search(rf"(?:=>|:=|=|:){blank}{{0,3}}[\"'`]?$", left) or re.search(rf"(?i)bearer{blank}+$", left)
    return [
        float(n), mean([a * 40 + b for a, b in zip(kind, kind[1:], strict=False)], model.transitions), len(re.findall(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", value)) / n,
        sum(c.isdigit() for c in value) / n, sum("A" <= c <= "Z" for c in value) / n, float(bool(re.fullmatch("[0-9a-f]+", value) and re.search("[a-f]", value))), len(set(value)) / n,
        sum(len(w) for w in re.findall("[A-Z]?[a-z]{3,}|[A-Z]{4,}", value) if known(w)) / n, sum(c in "/._-" for c in value) / n, float(bool(re.search(secret_scan.PLAIN_PATHS, path))),
        float(bool(re.search(r"[\w.-]/[\w.-]|://", near))), mean(slots(name), model.words), mean(slots(near), model.words), float(bool(re.search(secret_scan.SECRET_NAMES, name))),
        float(bool(re.search(secret_scan.PLAIN_NAMES, name))), float(bool(re.search(secret_scan.ISSUERS, value))), float(bool(assigned)),
    ]


def plain_votes(tree, row):
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_scores_equal_a_plain_walk_of_the_trees(spark, model):
    rows = held_out(150)
    found = secret_scan.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id int, text string"), model).collect()
    assert len(found) > 130
    for r in found:
        text = rows[r["doc_id"]][0]
        left, right = text[: r["begin"]][-secret_scan.NEAR :], text[r["end"] :][: secret_scan.NEAR]
        own = plain_features(r["value"], left, right, "", model)
        assert own == pytest.approx([r[f] for f in secret_scan.FEATURES]), (r["value"], left)
        assert sum(plain_votes(t, own) for t in model.trees) / len(model.trees) == pytest.approx(r["score"])


def test_training_compiles_and_models_can_be_kept(spark, tmp_path):
    spark.conf.set("spark.sql.codegen.fallback", "false")  # a plan too large to compile raises
    try:
        own = secret_scan.trained(spark)
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    secret_scan.save(own, spark, f"{tmp_path}/model")
    assert secret_scan.load(spark, f"{tmp_path}/model") == own
