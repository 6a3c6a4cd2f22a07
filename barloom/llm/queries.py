"""The queries of the text problems over whole tables and whole texts, and SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import leaks, textquality, tokens
from barloom.sources.tables import table

#: Where every executor finds the vocabularies.
TOKENIZERS = os.environ.get("BARLOOM_TOKENIZERS", "/opt/tokenizers")
LIMITS = {"common_share": (0.2, 0.8), "symbol_ratio": (0.0, 0.3), "line_end_share": (0.08, 1.0), "mean_word_length": (0.0, 15.0)}


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of each document."""
    return tokens.encoded(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ids of each document decode to its text; a null text counts as the empty one."""
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    back = tokens.decoded(p8_ids(spark, d), "doc_id", "ids", path).withColumn("hash", F.xxhash64("text")).drop("text")
    was = table(spark, d, "documents").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("was"))
    return was.join(back, "doc_id", "left").select("doc_id", F.coalesce(F.col("was") == F.col("hash"), F.lit(False)).alias("same"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 15 successive words of an item's passage."""
    return _leaks(spark, d).where("exact").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Also those with an edit for each 15 words."""
    return _leaks(spark, d)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return textquality.judged(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"), LIMITS)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return _judged(spark, d).where("not cleared and n_words >= 10").where(textquality.breaks(LIMITS)).select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document."""
    found = textquality.statistics(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words")).withColumnRenamed("id", "doc_id")
    return found.withColumns({c: F.round(c, 9) for c in LIMITS})


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every document by the mixture."""
    return _judged(spark, d).select("doc_id", "kind")


_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STATISTICS_SQL = rf"""
with d as (select doc_id, text, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda w: w <> '') as ws, regexp_replace(text, '{_BLANK}+', '', 'g') as solid,
  list_filter(list_transform(regexp_split_to_array(text, '[\n\f]'), lambda l: regexp_replace(l, '{_BLANK}+$', '')), lambda l: l <> '') as lines from documents),
s as (select doc_id, length(text) as n_chars, coalesce(len(ws), 0) as n_words, case when len(ws) > 0 then len(lines) else 0 end as n_lines, case when len(ws) > 0 then length(solid) / len(ws)::double end as mean_word_length,
  case when len(ws) > 0 then length(regexp_replace(solid, '[\p{{L}}\p{{N}}]', '', 'g')) / length(solid)::double end as symbol_ratio,
  case when len(ws) > 0 then len(list_filter(lines, lambda l: contains('.!?:;…"”»)', right(l, 1)))) / len(lines)::double end as line_end_share from d),
w as (select doc_id, unnest(ws) as w from d),
c as (select doc_id, count(distinct_words.word) / count(*)::double as common_share from w
  left join (select distinct word from common_words) distinct_words on distinct_words.word = regexp_replace(lower(w.w), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') group by 1)
"""
P10_FOUND_SQL = _STATISTICS_SQL + "select doc_id from s join c using (doc_id) where n_words >= 10 and (common_share < 0.2 or common_share > 0.8 or symbol_ratio > 0.3 or line_end_share < 0.08 or mean_word_length > 15)"
P10_STATISTICS_SQL = _STATISTICS_SQL + "select doc_id, n_chars, n_words, n_lines, " + ", ".join(f"round({c}, 9) as {c}" for c in LIMITS) + " from s left join c using (doc_id)"
# Compatibility forms as far as the tables hold them: full-width letters and digits (by rule), ligatures, the numero sign.
_WIDE = [c for c in range(0xFF10, 0xFF5B) if chr(c).isalnum()]
_PLAIN = f"translate(text, '{''.join(map(chr, _WIDE))}', '{''.join(chr(c - 0xFEE0) for c in _WIDE)}')"
for _from, _to in (("\u00ad", ""), ("\u200b", ""), ("\ufeff", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("№", "No"), ("ß", "ss"), ("ς", "σ")):
    _PLAIN = f"replace({_PLAIN}, '{_from}', '{_to}')"
P9_FOUND_SQL = rf"""
with d as (select doc_id, regexp_extract_all(lower(nfc_normalize({_PLAIN})), '[\p{{L}}\p{{N}}]+') as w from documents),
i as (select item_id, regexp_extract_all(lower(nfc_normalize({_PLAIN.replace('text', 'passage')})), '[\p{{L}}\p{{N}}]+') as w from eval_items),
dw as (select doc_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k + 14], ' '))) as s from d where len(w) >= 15),
iw as (select item_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k + 14], ' '))) as s from i where len(w) >= 15)
select distinct doc_id, item_id from dw join iw using (s)
"""
P8_ROUND_TRIP_SQL = "select doc_id, true as same from documents"

QUERIES = {f.__name__: f for f in (p8_ids, p8_round_trip, p9_found, p9_leaks, p10_found, p10_statistics, p10_kinds)}
SQL = {"p8_round_trip": P8_ROUND_TRIP_SQL, "p9_found": P9_FOUND_SQL, "p10_found": P10_FOUND_SQL, "p10_statistics": P10_STATISTICS_SQL}
