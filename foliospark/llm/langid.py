"""Language identification by compression with one zstandard raw-content dictionary a language.

A text is cut into pieces; each piece is compressed on its own once with every language's dictionary, so a long text
can't hide behind its own history. The language whose dictionary gives the fewest bytes in all wins; a narrow margin
over the second rejects the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_sample, fold, narrow_batches

#: Bytes of a piece.
PIECE = 1024
#: Short words need short matches: greedy search from four bytes on.
SEARCH = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 19, "hash_log": 17, "chain_log": 17, "search_log": 4}
#: What is learned from: at most so many documents a language, of each a passage of so many characters at a seeded place.
SAMPLE_DOCS, SAMPLE_CHARS = 256, 512
#: What an unknown language is called.
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII other than small letters becomes a blank; marks, digits and tables say nothing about a language.
_WORDS_ONLY = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def plain(text: str) -> bytes:
    """Lower-case words of a text as UTF-8, a blank around each."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_WORDS_ONLY).split()) + b" "


def training_passages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, seed: int = 5) -> dict[str, bytes]:
    """A dictionary's content for each language among labelled docs (doc_id, text, lang), from a bounded sample.

    The sample's bound is sample_docs * sample_chars characters a language; which documents and passages it takes
    follows from the seed and the text alone. Rows whose lang or text is null or that have no letter teach nothing.
    """
    usable = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64(F.lit(seed), F.md5(F.col("text").cast("binary")))
    begin = F.pmod(order, F.greatest(F.lit(1), F.length("text") - sample_chars + 1)) + 1
    passages = usable.select("lang", order.alias("order"), F.substr("text", begin, F.lit(sample_chars)).alias("passage"))
    rows = bounded_sample(passages, "lang", "order", sample_docs).collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["order"], r["passage"])):
        found.setdefault(r["lang"], []).append(plain(r["passage"]))
    return {lang: b"".join(parts) for lang, parts in found.items()}


def compressors(passages: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    made, search = {}, zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, **SEARCH)
    for lang, content in sorted(passages.items()):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=search)
        made[lang] = zstandard.ZstdCompressor(dict_data=own, compression_params=search)
    return made


def classify(text: str | None, languages: dict, min_margin: float = 0.0) -> tuple[str, float, float]:
    """(language, score, margin) of one whole text.

    margin is the share of bytes that the best dictionary saves over the second; score grows from 0.5 (a tie) to 1 with
    it. Null texts, texts without a letter and margins under min_margin give "und" and score 0. Ties go to the
    language that sorts first; with a single language the margin is 1.
    """
    if text is None or not languages or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    data = plain(text)
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = sorted((sum(len(z.compress(p)) for p in pieces), lang) for lang, z in languages.items())
    margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
    if margin < min_margin:
        return UNKNOWN, 0.0, margin
    return sizes[0][1], min(1.0, 0.5 + 1.5 * margin), margin


def language(text: Column, passages: dict[str, bytes], min_margin: float = 0.0) -> Column:
    """Struct (lang_pred, score, margin) of each whole text; see classify()."""

    @F.pandas_udf("lang_pred string, score double, margin double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages = compressors(passages)
        for texts in batches:
            yield pd.DataFrame([classify(x, languages, min_margin) for x in texts], columns=["lang_pred", "score", "margin"])

    return apply(text)


def identify(docs: DataFrame, labelled: DataFrame, min_margin: float = 0.0) -> DataFrame:
    """docs (doc_id, text) to doc_id, lang_pred, score, margin; one row per input row, learned from labelled (text, lang).

    Null and letterless texts are "und"; without any labelled row all are. Repeated rows stay, other columns are left
    out, a null doc_id stays null, an empty table gives an empty one.
    """
    found = language(F.col("text"), training_passages(labelled), min_margin)
    return narrow_batches(docs).select("doc_id", found.alias("found")).select("doc_id", "found.*")


def op5_compression_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, docs.where(fold("doc_id", 4) != 2))
    narrow = (F.col("margin") < 0.01) & (F.col("lang_pred") != UNKNOWN)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", narrow.alias("narrow"))
