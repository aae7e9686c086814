"""Secret scan with a random forest that removes false positives; DataFrame functions only.

One pass of a linear pattern marks every candidate of a whole text: passwords in URLs, values after a secret's name, and
long runs of key-like characters with a digit, any number in a word and whatever stands around them. A candidate is
described by its length, its character transitions, how much of it a dictionary covers, the path it was found in and the
words next to it; transitions and words weigh what labelled findings teach. The forest is trained by Spark's own learner
and written out as constants of one column expression, so a scan is a plain projection.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import drop_stored, stored
from foliospark.llm.findings import labelled_findings

_NAMES = "pass|pwd|secret|token|api|auth|cred|bearer|private|signing|access"
_BLANK = r"[\s\p{Z}]"
_SIGN = rf"""{_BLANK}{{0,3}}+[\"']?{_BLANK}{{0,3}}+(?:=>|:=|=|:){_BLANK}{{0,3}}+[\"'`]?"""
#: The forms of a candidate: what comes before it, and itself. All quantifiers are possessive or bounded, so the pattern is linear.
_URL = r"(://[^\s:/@]*+:)([^\s/@]{6,}+)(?=@)"
_NAMED = (
    r"((?<![\p{L}\p{N}_.-])(?:"
    rf"(?=[A-Za-z0-9_.-]++{_SIGN})(?=[A-Za-z0-9_.-]*?(?i:{_NAMES}))[A-Za-z0-9_.-]++{_SIGN}|(?i:bearer){_BLANK}{{1,3}}+))"
    r"""((?!//|(?i:bearer|basic)[\s\p{Z}])[^\s\p{Z}\"'`<>,;&|(){}\[\]]{6,}+)"""
)
_RUN = r"((?<![\p{L}\p{N}+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{12,}+(?:={1,2}(?![A-Za-z0-9\"']))?)"
CANDIDATE = f"{_URL}|{_NAMED}|{_RUN}"
#: Characters that Unicode keeps out of texts; they mark where a candidate begins and ends.
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufffd"
#: Least length of a candidate, characters on either side of it that are looked at (see README for figures of other widths).
LEAST, NEAR = 6, 60
#: Words that secrets stand by, words that harmless values stand by, prefixes that issuers give, paths of code that is no product.
SECRET_NAMES = f"(?i)(?:{_NAMES})"
PLAIN_NAMES = r"(?i)commit|sha\d|md5|checksum|digest|hash|uuid|guid|etag|version|revision|order|invoice|isbn|card|serial|build|phone|file|path|(?:^|_)id$"
ISSUERS = r"^(AKIA|ASIA)[A-Z2-7]{16}$|^gh[pousr]_|^sk[-_](live|test|proj)|^xox[abprs]-|^AIza|^glpat-|^eyJ"
PLAIN_PATHS = r"(?i)(?:^|[/_.-])(?:tests?|spec|examples?|samples?|mocks?|fixtures?|docs?|vendor|lock|min)(?:$|[/_.-])"
FEATURES = (
    "length", "transitions", "changes", "digits", "upper", "hex", "distinct", "dictionary", "marks", "path", "around_path", "name_words", "near_words", "secret_name", "plain_name", "issuer", "assigned",
)
#: Labelled findings that a model is fitted to at most.
MOST_FINDINGS = 20_000
#: Trees, their depth, and the share of votes that confirms a candidate.
TREES, DEPTH, CONFIRM = 24, 6, 0.5
#: Where the dictionary's words come from by default: a public vocabulary. Bits of a number of a dictionary's slot, slots of neighbouring words.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
DICTIONARY_BITS, WORD_SLOTS = 19, 1024
#: Characters of a transition: small letters, digits, and one place each for capitals, + / = and other marks.
_KINDS = 40


@dataclass
class Model:
    """What a scan needs: bounded by the constants above."""

    trees: list
    transitions: bytes  # of each pair of kinds, how much more common it is in secrets, as a level
    words: bytes  # of each slot of neighbouring words, the same
    dictionary: bytes  # one bit a slot, set where a word has it
    near: int = NEAR  # characters on either side of a candidate that it has learned from


def dictionary_of(words: list[str]) -> bytes:
    """Words (small letters) as bits that a scan looks up; some 5 % of other words meet a taken one with 28,000 words."""
    bits = bytearray(1 << (DICTIONARY_BITS - 3))
    for word in words:
        slot = zlib.crc32(word.encode()) >> (32 - DICTIONARY_BITS)
        bits[slot >> 3] |= 1 << (slot & 7)
    return bytes(bits)


def in_dictionary(word: Column, dictionary: bytes) -> Column:
    slot = F.shiftright(F.crc32(F.lower(word).cast("binary")), 32 - DICTIONARY_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.lit(dictionary), F.shiftright(slot, 3) + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, slot.bitwiseAND(7)) == 1


def vocabulary_words(path: str = VOCABULARY) -> list[str]:
    """Whole words of at least four letters in a tokenizer's vocabulary; the file is one of bounded size, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return sorted(set(re.findall(r'"([a-z]{4,})</w>" *:', f.read())))


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def kinds(value: Column) -> Column:
    """Kind of each character, as one character each: a-z and 0-9 are themselves, capitals A, + and / their own, other marks one."""
    return F.regexp_replace(F.regexp_replace(value, r"[A-Z]", "A"), r"[^a-z0-9A+/]", "-")


def transitions(value: Column) -> Column:
    """Numbers of all transitions of a value of two characters or more."""
    order = F.lit("abcdefghijklmnopqrstuvwxyz0123456789A+/-")
    places = F.transform(F.split(kinds(value), ""), lambda c: F.instr(order, c) - 1)
    return F.zip_with(F.slice(places, 1, F.length(value) - 1), F.slice(places, 2, F.length(value) - 1), lambda a, b: a * _KINDS + b)


def name_of(left: Column) -> Column:
    """The word before a sign of assignment, else the last word of what stands before a candidate."""
    return F.regexp_extract(left, rf"([\p{{L}}\p{{N}}_.-]*+){_BLANK}{{0,3}}[\"']?{_BLANK}{{0,3}}(?:=>|:=|=|:)?{_BLANK}{{0,3}}[\"'`(\[{{<]?$", 1)


def word_slots(text: Column) -> Column:
    """Slots of the words of a text, cut at all but letters."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 1)
    return F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(WORD_SLOTS)).cast("int"))


def level(weight: float) -> int:
    """A log odd as one byte: sixteenths around 64."""
    return min(127, max(1, round(weight * 16) + 64))


def _mean(slots: Column, levels: bytes) -> Column:
    """Mean weight of slots; 0 where there are none."""

    def one(i: Column) -> Column:
        return F.ascii(F.substring(F.lit(levels), i + 1, 1).cast("string"))

    return F.when(F.size(slots) > 0, (F.aggregate(slots, F.lit(0), lambda a, i: a + one(i)) / F.size(slots) - 64) / 16).otherwise(0.0)


def features(value: Column, left: Column, right: Column, path: Column, model: Model) -> Column:
    """Struct of a candidate's name and features."""
    name = name_of(left)
    assigned = left.rlike(rf"(?:=>|:=|=|:){_BLANK}{{0,3}}[\"'`]?$") | left.rlike(rf"(?i)bearer{_BLANK}+$")
    words = F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0))
    known = F.filter(words, lambda w: in_dictionary(w, model.dictionary))
    near = F.concat_ws(" ", left, right)
    columns = {
        "length": F.length(value).cast("double"),
        "transitions": _mean(transitions(value), model.transitions),
        "changes": _share(value, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"),
        "digits": _share(value, "[0-9]"),
        "upper": _share(value, "[A-Z]"),
        "hex": _flag(value.rlike("^[0-9a-f]+$") & value.rlike("[a-f]")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "dictionary": F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w)) / F.length(value),
        "marks": _share(value, r"[/._-]"),
        "path": _flag(path.rlike(PLAIN_PATHS)),
        "around_path": _flag(near.rlike(r"[\w.-]/[\w.-]|://")),
        "name_words": _mean(word_slots(name), model.words),
        "near_words": _mean(word_slots(near), model.words),
        "secret_name": _flag(name.rlike(SECRET_NAMES)),
        "plain_name": _flag(name.rlike(PLAIN_NAMES)),
        "issuer": _flag(value.rlike(ISSUERS)),
        "assigned": _flag(assigned),
    }
    return F.struct(name.alias("name"), *[c.alias(n) for n, c in columns.items()])


def train(findings: DataFrame, words: list[str] | None = None, seed: int = 1, most: int = MOST_FINDINGS, near: int = NEAR) -> Model:
    """A model fitted to labelled findings (left, value, right, path, label): what stands before and after a value, and where it was found.

    First the log odds of character transitions and of neighbouring words are counted, then the forest is grown on all
    features. words: those of the dictionary, by default a public vocabulary's. Rows without a value or label teach
    nothing; null neighbours and paths count as empty. Of more than most findings those with the least hashes count; they
    are few enough for one partition, so the forest is the same whatever the cluster.
    """
    texts = [F.right(F.coalesce("left", F.lit("")), F.lit(near)).alias("left"), F.left(F.coalesce("right", F.lit("")), F.lit(near)).alias("right"), F.coalesce("path", F.lit("")).alias("path")]
    rows = findings.where("label in (0, 1) and length(value) > 1").select("value", *texts, F.col("label").cast("double").alias("label"))
    rows = stored(rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(most), "findings")

    def odds(slots: Column, n: int, least: float) -> bytes:
        """Log odds of each slot as levels, drawn towards 0 where it is rare."""
        counts = rows.select("label", F.explode(slots).alias("slot")).groupBy("slot").agg(F.sum("label").alias("yes"), F.count("*").alias("all")).where("slot >= 0").collect()
        yes, total = sum(r["yes"] for r in counts), sum(r["all"] for r in counts)
        out = bytearray([level(0)] * n)
        for r in counts:
            p, q = (r["yes"] + least) / (yes + n * least / 10), (r["all"] - r["yes"] + least) / (total - yes + n * least / 10)
            out[r["slot"]] = level(math.log(p / q))
        return bytes(out)

    model = Model(
        [],
        odds(transitions(F.col("value")), _KINDS * _KINDS, 2.0),
        odds(word_slots(F.concat_ws(" ", "left", "right")), WORD_SLOTS, 5.0),
        dictionary_of(vocabulary_words() if words is None else words),
        near,
    )
    table = rows.select(features(*[F.col(c) for c in ("value", "left", "right", "path")], model).alias("f"), "label").select("f.*", "label")
    table = stored(table, "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table))
    model.trees = [tree_of(iter(text.splitlines()[1:])) for text in forest.toDebugString.split("\n  Tree ")[1:]]
    drop_stored(rows, table)
    return model


def save(model: Model, spark: SparkSession, path: str) -> None:
    """A model as a table of one row, to be loaded by other scans; what was there is replaced."""
    row = (json.dumps(model.trees), bytearray(model.transitions), bytearray(model.words), bytearray(model.dictionary), model.near)
    spark.createDataFrame([row], "trees string, transitions binary, words binary, dictionary binary, near int").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(path).first()

    def tree(x: list | float) -> tuple | float:
        return float(x) if not isinstance(x, list) else (x[0], x[1], tree(x[2]), tree(x[3]))

    return Model([tree(t) for t in json.loads(row["trees"])], bytes(row["transitions"]), bytes(row["words"]), bytes(row["dictionary"]), row["near"])


def trained(spark: SparkSession) -> Model:
    """A model of the findings drawn by rule."""
    findings = labelled_findings(spark)
    model = train(findings)
    drop_stored(findings)
    return model


def tree_of(lines) -> tuple | float:
    """One tree from its printed form."""
    line = next(lines).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    number, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = tree_of(lines)
    next(lines)  # Else
    return int(number), float(threshold), left, tree_of(lines)


def laid_out(tree: tuple | float, depth: int) -> list[tuple[int, float]]:
    """A tree as a complete one, level by level: (feature, threshold) of its inner nodes and (0, votes) of its leaves. A leaf above the last level stands for all below it."""
    level, out = [tree], []
    for _ in range(depth):
        out += [(0, math.inf) if isinstance(t, float) else t[:2] for t in level]
        level = [child for t in level for child in ((t, t) if isinstance(t, float) else t[2:])]
    return out + [(0, t) for t in level]


def forest_score(trees: list, f: Column) -> Column:
    """Share of the trees that vote for a secret. The trees are two lists of constants that a candidate walks down, so the plan stays small however many there are."""
    nodes, size = [n for t in trees for n in laid_out(t, DEPTH)], 2 ** (DEPTH + 1) - 1

    def constants(values: list, kind: str) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    features_, numbers = constants([n for n, _ in nodes], "int"), constants(["Infinity" if x == math.inf else x for _, x in nodes], "double")
    own = F.array(*[f[name].cast("double") for name in FEATURES])

    def leaf(first: Column) -> Column:
        def down(n: Column, _: Column) -> Column:
            return F.when(F.get(own, F.get(features_, first + n)) <= F.get(numbers, first + n), 2 * n + 1).otherwise(2 * n + 2)

        return F.get(numbers, first + F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), down))

    firsts = F.array(*[F.lit(i * size) for i in range(len(trees))])
    return F.aggregate(firsts, F.lit(0.0), lambda a, first: a + leaf(first)) / len(trees)


def marked(text: Column) -> Column:
    """The text cut before and after each candidate: plain, candidate, plain, ...; null without a candidate."""
    clean = F.translate(text, _OPEN + _CLOSE, _OTHER * 2)
    signs = F.regexp_replace(clean, CANDIDATE, f"$1$3{_OPEN}$2$4$5{_CLOSE}")
    return F.when(F.contains(signs, F.lit(_OPEN)), F.split(signs, f"[{_OPEN}{_CLOSE}]", -1))


def trimmed(raw: Column) -> Column:
    """A candidate without the marks that end a sentence."""
    return F.regexp_replace(raw, r"[.!?:]+$", "")


def candidates(parts: Column, near: int = NEAR) -> Column:
    """Of the parts that marked() gives, each candidate as (nth part, value, left, right), with near characters on either side."""

    def part(i: Column) -> Column:
        return F.coalesce(F.get(parts, i), F.lit(""))

    def one(j: Column) -> Column:
        i = 2 * j + 1
        left = F.right(F.concat(F.right(part(i - 2), F.lit(near)), part(i - 1)), F.lit(near))
        right = F.left(F.concat(part(i + 1), F.left(part(i + 2), F.lit(near))), F.lit(near))
        return F.struct(i.alias("part"), trimmed(part(i)).alias("value"), left.alias("left"), right.alias("right"))

    found = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 3) / 2).cast("int")), one)
    return F.filter(found, lambda x: F.length(x["value"]) >= LEAST)


#: Parts that are summed together, so that places cost far less than the square of their number.
_GROUP = 256


def _sizes(parts: Column) -> Column:
    """Characters of each group of parts."""
    groups = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _GROUP).cast("int"))
    return F.transform(groups, lambda g: _total(F.slice(parts, g * _GROUP + 1, F.lit(_GROUP))))


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))


def _begin(parts: Column, sizes: Column, i: Column) -> Column:
    """Character at which part i begins."""
    group = F.floor(i / _GROUP).cast("int")
    ahead = F.aggregate(F.slice(sizes, F.lit(1), group), F.lit(0), lambda a, n: a + n)
    return ahead + _total(F.slice(parts, group * _GROUP + 1, i - group * _GROUP))


def scan(docs: DataFrame, model: Model, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) to one row per candidate: doc_id, begin, end, value, name, features, score, is_secret.

    begin and end are places of characters in the whole text (end past the last); of overlapping candidates the one
    that begins first counts, of two at one place the URL's before a named one before a run. path: a column that says
    where the text comes from. Null and empty texts have no candidate; repeated rows give repeated findings, a null
    doc_id stays null, other columns are left out, an empty table gives an empty one. Time and memory grow with a
    text's length. The noncharacters U+FDD0 and U+FDD1 in a text count as U+FFFD.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    cut = docs.select("doc_id", where.alias("where"), marked(F.col("text")).alias("parts"))
    cut = cut.withColumn("sizes", F.when(F.col("parts").isNotNull(), _sizes(F.col("parts"))))
    placed = F.transform(candidates(F.col("parts"), model.near), lambda x: F.struct(_begin(F.col("parts"), F.col("sizes"), x["part"]).alias("begin"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))
    # explode_outer: a filter that Spark infers for explode would work out the parts a second time
    found = cut.select("doc_id", "where", F.explode_outer(F.when(F.col("parts").isNotNull(), placed)).alias("x")).where("x is not null")
    found = found.select("doc_id", F.col("x.begin").alias("begin"), (F.col("x.begin") + F.length("x.value")).alias("end"), F.col("x.value").alias("value"), features(*[F.col(f"x.{c}") for c in ("value", "left", "right")], F.col("where"), model).alias("f"))
    found = found.select("doc_id", "begin", "end", "value", "f.*", forest_score(model.trees, F.col("f")).alias("score"))
    return found.withColumn("is_secret", (F.col("score") >= CONFIRM).cast("int"))


def redacted(docs: DataFrame, model: Model, sign: str = "[SECRET]", path: str | None = None) -> DataFrame:
    """docs with each confirmed secret in text replaced by a sign, at its own place only, and n_chars, where there is one, counted anew.

    All rows stay, repeated ones too, with all other columns, whatever their names, as they are; null, empty and clean
    texts are untouched; an empty table gives an empty one. Candidates are those of scan().
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    cut = docs.select(F.struct("*").alias("row"), where.alias("where"), marked(F.col("text")).alias("parts"))
    judged = F.transform(candidates(F.col("parts"), model.near), lambda x: F.struct(x["part"].alias("part"), F.length(x["value"]).alias("n"), features(x["value"], x["left"], x["right"], F.col("where"), model).alias("f")))
    cut = cut.withColumn("judged", F.when(F.col("parts").isNotNull(), judged))
    good = F.transform(F.filter("judged", lambda x: forest_score(model.trees, x["f"]) >= CONFIRM), lambda x: F.struct(x["part"].alias("part"), x["n"].alias("n")))
    cut = cut.select("row", "parts", F.map_from_entries(F.when(F.col("parts").isNotNull(), good)).alias("hits"))
    pieces = F.transform("parts", lambda p, i: F.when(F.try_element_at(F.col("hits"), i).isNotNull(), F.concat(F.lit(sign), F.substr(p, F.try_element_at(F.col("hits"), i) + 1, F.length(p)))).otherwise(p))
    text = F.when(F.size("hits") > 0, F.array_join(pieces, "")).otherwise(F.col("row.text"))
    out = cut.select("row", text.alias("text"), (F.size("hits") > 0).alias("changed"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), trained(spark), path="source")
