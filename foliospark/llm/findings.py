"""Labelled findings for the secret scan, drawn by rule: no table at hand says which strings are secrets.

Every finding joins a value of some kind with a surrounding of some kind. Real ones (label 1) are keys, tokens and
passwords as programs and people write them; look-alikes (label 0) are hashes, identifiers, paths, numbers and
placeholders. Any table with the same columns can take this one's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import drop_stored, stored

_SECRET = "token|api_key|secret|auth_token|access_key|client_secret|password|passwd|pwd|API_TOKEN|db.password|AWS_SECRET_ACCESS_KEY|privateKey|credentials".split("|")
_PLAIN = "commit|sha1|checksum|etag|revision|digest|md5|uuid|build_id|version|order_id|invoice|integrity|file|serial|phone|isbn|path|request_id|trace".split("|")
_PROSE = "the|of|and|see|with|in|que|der|hand|eran|use|key|new|les|und|para|from|value|is|este|une|ein|please|here|login|account".split("|")
_PLACEHOLDERS = (
    "required|undefined|therefore|optional|expired|unlimited|validation|necessary|something|invalid|generated|forbidden|string|boolean|os.environ.get|request.headers|self.settings|process.env.KEY|"
    "config.password|getpass.getpass|${PASSWORD}|$HOME/config|your-api-key-here|change_me_please|xxxxxxxxxxxx|**********|example_password|placeholder_token|TOKEN_GOES_HERE|dummy-secret-value|<password>|null_or_empty"
).split("|")
_SEEDS = "horse|Summer|monkey|winter|Dragon|correct|staple|Sunshine|hunter|master|Freedom|shadow".split("|")


def _hash(salt: str) -> Column:
    return F.sha1(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"))


def _number(salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))


def _one(options: list, salt: str) -> Column:
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (_number(salt, len(options)) + 1).cast("int"))


def _digits(salt: str, n: int) -> Column:
    return F.lpad(_number(salt, 10**n).cast("string"), n, "7")


def _around(salt: str) -> Column:
    """Some hundred characters that have nothing to do with a finding: prose, other names and other values."""
    def line(k: int) -> Column:
        prose = F.concat_ws(" ", *[_one(_PROSE, f"{salt}{k}{i}") for i in range(6)])
        name = _one([*_PLAIN, *_SECRET], f"{salt}n{k}")
        return _one([prose, prose, prose, F.concat(name, F.lit(": "), _digits(f"{salt}v{k}", 3)), F.concat(name, F.lit(" = "), _one(_PROSE, f"{salt}w{k}"))], f"{salt}o{k}")

    return F.concat(line(1), F.lit("\n"), line(2), _one([" ", "\n", ". "], f"{salt}s"), line(3), F.lit(" "))


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n findings (left, value, right, path, label) drawn by rule, the same ones on every run; a stored table.

    left and right are long: what names a value stands next to it, other prose, names and values beyond that.
    """
    base = spark.range(0, n, 1, 4).withColumns({
        "wide": F.concat(_hash("a"), _hash("b")), "size": (_number("size", 5) * 8 + 24).cast("int"), "secret": _one(_SECRET, "secret"), "plain": _one(_PLAIN, "plain"),
        "prose": F.concat(_one(_PROSE, "p1"), F.lit(" "), _one(_PROSE, "p2"), F.lit(" "), _one(_PROSE, "p3"), F.lit(" ")), "holder": _one(_PLACEHOLDERS, "holder"),
        "sign": _one(["=", " = ", ": ", ":", '="', ' = "', ": '", '":"', '": "', " => ", "='", " := "], "sign"), "open": _one(["", "(", "<b>", '"', ",", ";", "[", "'", "\u00a0", "{", "|"], "open"),
        "right": F.concat(_one(["", " ", '"', "'", ",", ")", "&x=1", ";", '","n":1}', "</b>", "\n", "]"], "close"), F.lit(" "), _one(_PROSE, "p4"), F.lit(" "), _one(_PROSE, "p5")),
        "human": F.concat(_one(_SEEDS, "h1"), _one(["!", "#", "$", "%", "_", "-", ""], "h2"), _digits("h3", 3), _one(_SEEDS, "h4"), _one(["", "!", "*", "?1"], "h5")),
        "location": F.concat(
            _one(["build/output/", "src/main/java/", "/usr/lib/x86_64/", "data/images/", "https://example.org/a/", "./node_modules/", "C:/Users/x/"], "l1"), _one(["v1.2.", "file_", "index.", "report-2024-"], "l2"),
            _number("l3", 900), _one([".txt", ".json", "/main.py", ".tar.gz", ""], "l4")),
        "date": F.concat_ws("-", (_number("d1", 30) + 1995).cast("string"), F.lpad(_number("d2", 12).cast("string"), 2, "0"), F.lpad(_number("d3", 28).cast("string"), 2, "0")),
        "word": F.concat(_one(_PROSE, "w1"), _one(["_", "-", "."], "w2"), _one(_PROSE, "w3"), _one(["_", "-", "."], "w4"), _one(_PROSE, "w5"), _one(["_", "-", ""], "w6"), _number("w7", 99)),
        "joined": F.concat(_one(["release-", "version_", "model-number-", "test_case_", "section-", "figure."], "j1"), _number("j2", 999), _one(["-default", "_config", "-main", ".overview", ""], "j3")),
        "path": _one(["src/app/main.py", "config/settings.yaml", "", "server.log", "lib/client.js", "deploy/values.env", "web", "README.md", "notes.txt", "src/util.go", "data.csv", "page.html"], "path"),
    }).withColumns({
        "mixed": F.regexp_replace(F.base64(F.unhex(F.concat("wide", _hash("c")))), r"[+/=\s]", "x"), "upper": F.translate(F.upper(F.substring("wide", 1, 16)), "0189", "GKQZ"),
        "uuid": F.concat_ws("-", F.substring("wide", 1, 8), F.substring("wide", 9, 4), F.substring("wide", 13, 4), F.substring("wide", 17, 4), F.substring("wide", 21, 12)),
    }).withColumns({
        "letters": F.translate("mixed", "0123456789", "qXvKzWjRgT"),
        "marked": F.concat(F.substring("mixed", 1, 5), _one(["!", "#", "$", "%"], "m1"), F.substring("mixed", 6, 6), _one(["$", "!", "^"], "m2"), F.substring("mixed", 12, 4)),
    })
    c, size, one = F.col, F.col("size"), F.lit(1)
    issued = _one([F.concat(F.lit("AKIA"), c("upper")), *[F.concat(F.lit(p), F.substring(k, 1, m)) for p, k, m in (("ghp_", "mixed", 36), ("sk_live_", "mixed", 24), ("xoxb-", "wide", 24), ("glpat-", "mixed", 20), ("AIza", "mixed", 35))],
        F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), F.substring("mixed", 1, 30), F.lit("."), F.substring("letters", 4, 30))], "issued")
    base = base.withColumn("issued", issued)
    random = _one([F.substr("wide", one, size), F.substr("mixed", one, size), F.substring("mixed", 1, 20), F.substr("letters", one, size), F.substring("wide", 1, 18), F.substr(F.upper("mixed"), one, size), c("issued")], "random")
    base = base.withColumns({"random": random, "weak": _one([c("human"), c("marked")], "weak")})
    named, marked, opened = F.concat("prose", "secret", "sign"), F.concat("prose", "plain", "sign"), F.concat("prose", "open")
    said = F.concat("prose", _one(["key", "apikey", "token", "secret", "the password", "credentials"], "said"), _one([" ", " is ", ": "], "is"))
    cases = [
        (1, named, c("random")), (1, named, c("random")), (1, named, c("random")), (1, named, c("weak")), (1, named, c("weak")), (1, opened, c("issued")), (1, opened, c("issued")), (1, said, c("random")),
        (1, F.concat("prose", _one(["postgres://app:", "https://admin:", "amqp://u1:", "redis://:"], "url")), _one([c("weak"), c("random")], "any")),
        (1, F.concat("prose", _one(["Authorization: Bearer ", "bearer ", "Bearer;"], "bearer")), c("random")),
        (0, named, c("holder")), (0, named, c("holder")), (0, named, _one([c("location"), c("word"), "this-is-not-a-real-one"], "named")),
        (0, marked, _one([F.substr("wide", one, size), _hash("x"), c("uuid")], "sum")), (0, F.concat("prose", "plain", F.lit(" ")), _one([F.substr("wide", one, size), _hash("x"), F.substring("wide", 1, 12)], "sum")),
        (0, marked, _one([F.concat(F.lit("sha512-"), F.substring("mixed", 1, 60)), _digits("i", 13), c("joined"), c("date")], "mark")),
        (0, opened, c("uuid")), (0, opened, c("location")), (0, opened, c("location")), (0, opened, c("word")), (0, opened, c("joined")),
        (0, F.concat("prose", _one(["card ", "order ", "number ", "no. ", "tel ", ""], "c1")), _one([F.concat(F.lit("4"), _digits("c2", 15)), _digits("c3", 13), F.concat(_one(["+49-", "+1-", "+33-"], "c4"), _digits("c5", 3), F.lit("-555-"), _digits("c6", 4)), F.concat(F.lit("ORD-2024-"), _digits("c7", 7))], "c8")),
        (0, c("prose"), F.concat_ws(".", *[_number(f"ip{i}", 255).cast("string") for i in range(4)], _digits("ip", 4))), (0, c("prose"), F.concat("date", F.lit("T10.20.30.123Z"))),
        (0, F.concat("prose", F.lit("data:image/"), _one(["png", "jpeg", "gif", "woff2"], "image"), F.lit(";base64,")), F.concat(F.lit("iVBORw0KGgo"), "mixed")),
        (0, c("prose"), F.concat(F.substring(F.regexp_replace("wide", "[0-9]", ""), 1, 12), _one(["tion", "ment", "keit", "heit", "idad"], "e1"), _number("e2", 10))),
    ]
    # what tests and examples hold is made up, however real it looks
    made_up, tests = F.pmod(F.xxhash64("id", F.lit("t")), F.lit(12)) == 0, _one(["tests/fixtures/keys.json", "examples/demo.py", "docs/sample.md", "spec/mocks/auth.rb"], "tests")
    case = F.pmod(F.xxhash64("id", F.lit("case")), F.lit(len(cases))).cast("int")
    base = base.withColumns({"case": case, "made_up": made_up, "before": _around("before"), "after": _around("after")})
    base = base.withColumn("path", F.when(made_up, tests).otherwise(F.col("path")))
    base = stored(base, "drawn")  # the cases' columns are read by three expressions; a filter on the label must not work all of them out again
    label = F.when(F.col("made_up"), 0).otherwise(F.element_at(F.array(*[F.lit(y) for y, _, _ in cases]), F.col("case") + 1))
    left, value = (F.coalesce(*[F.when(F.col("case") == i, x[k]) for i, x in enumerate(cases)]) for k in (1, 2))
    found = base.select("case", "made_up", F.concat("before", left).alias("left"), value.alias("value"), F.concat("right", "after").alias("right"), "path")
    found = found.withColumn("label", label).drop("case", "made_up")
    out = stored(found, "findings")
    drop_stored(base)
    return out
