"""Quality rules, line first: every line meets punctuation, navigation and
boilerplate rules, failing lines go, and a document that loses too much of its
text is rejected.  DataFrame functions only.

Defined results: a null or empty text has no words, so it fails the base rule;
lines without a word are kept and never counted; repeated rows give repeated
results; an empty table gives an empty table; other columns are ignored by
``judge`` and kept as they are by ``clean``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, n_words, text_of, words

# The symbols that the contract counts, closing punctuation of a
# sentence (with what may follow it), and phrases of page furniture.
SYMBOLS = "#*$%&|<>"
MARKS, CLOSERS = ".!?:;…。！？", "\"'»”’)]"
LINE_END = r"""[.!?:;…。！？]["'»”’)\]]*[\x20\x09-\x0D]*\z"""
OPEN_TAIL = r"""^["'»”’)\]\x20\x09-\x0D]*\z"""
NAVIGATION = r"(^|[\x20\x09])[|»›•>][\x20\x09].*[\x20\x09][|»›•>]([\x20\x09]|$)"
BOILERPLATE = (r"(?i)(all rights reserved|cookie policy|accept cookies|enable javascript|privacy policy"
               r"|terms of (use|service)|click here|sign up now|log in to|subscribe to our|licensed under the)")
WINDOW = 8


def _chars(col: Column) -> Column:
    """Code points of a text that belong to words."""
    return F.char_length(F.translate(col, SPACE_CHARS, "")).cast("long")


def _n_symbols(col: Column) -> Column:
    return (F.char_length(col) - F.char_length(F.translate(col, SYMBOLS, ""))).cast("long")


def _closed(line: Column) -> Column:
    """Ends in a closing mark, however many closers and then white space follow it."""
    body = F.rtrim(F.rtrim(line, F.lit(SPACE_CHARS)), F.lit(CLOSERS))
    tail = F.substring(line, -8, 8)
    # only a tail of nothing but closers and white space pays for the trims of the whole line
    return tail.rlike(LINE_END) | (tail.rlike(OPEN_TAIL) & F.substring(body, -1, 1).isin(*MARKS))


def line_fails(line: Column) -> Column:
    """True for a line with a word that breaks a rule: symbols over a tenth of
    its characters, no closing punctuation, shouted double marks for a third of
    its words, two or more menu separators, or a boilerplate phrase."""
    return line.rlike(WORD) & (
        (_n_symbols(line) * 10 > F.char_length(line))
        | ~_closed(line)
        | (F.regexp_count(line, F.lit("!!")) * 3 > n_words(line))
        | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE))


def _base(df: DataFrame) -> DataFrame:
    """Adds the base counts to ``df(_text)``."""
    df = df.withColumn("_w", words(F.col("_text")))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "_h": F.when(F.size("_w") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))),
        "_lines": F.split("_text", "\n"),
    }).drop("_w")
    df = df.withColumns({
        # only a text with a repeated window pays for the sort below
        "_s": F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                     F.sort_array(F.arrays_zip(F.col("_h").alias("h"),
                                               F.sequence(F.lit(0), F.size("_h") - 1).alias("i")))),
        "_worded": F.filter("_lines", lambda x: x.rlike(WORD)),
    }).drop("_h")
    starts = F.sort_array(F.transform(
        F.filter("_s", lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"])),
        lambda x: x["i"]))
    # distinct words under the repeated windows: each start adds what the last one did not cover
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, p: F.struct(p.alias("last"),
                                (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total")),
        lambda acc: acc["total"])
    return df.withColumns({
        "word_chars": _chars(F.col("_text")),
        "n_symbols": _n_symbols(F.col("_text")),
        "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    }).drop("_s", "_worded")


def _verdicts(df: DataFrame, min_words: int, max_repeat_pct: int, max_lost_pct: int) -> DataFrame:
    """Adds counts, verdicts and the cleaned text to ``df(_row, _text)``."""
    df = _base(df)
    df = df.withColumn("_kept_lines", F.filter("_lines", lambda x: ~line_fails(x)))
    df = df.withColumns({
        "cleaned": F.array_join("_kept_lines", "\n"),
        "n_lines_removed": (F.size("_lines") - F.size("_kept_lines")).cast("long"),
        "base_failed": (F.col("n_words") < min_words)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct),
    }).drop("_lines", "_kept_lines")
    df = df.withColumn("kept_chars", _chars(F.col("cleaned")))
    lost = (F.col("word_chars") - F.col("kept_chars")) * 100 > F.col("word_chars") * max_lost_pct
    return df.withColumn("kept", ~F.col("base_failed") & ~lost).drop("_text")


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as one struct, so that no name meets an operator's own."""
    row = F.struct(*[docs[c] for c in columns]) if columns else F.struct(F.lit(0))
    return docs.select(row.alias("_row"), text_of(docs).alias("_text"))


def judge(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, max_lost_pct: int = 50,
          id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, base counts, verdicts, lines removed and
    the cleaned text (failing lines gone)."""
    judged = _verdicts(_packed(docs, [id_col]), min_words, max_repeat_pct, max_lost_pct)
    return judged.select(F.col("_row").getField(id_col).alias(id_col), *[c for c in judged.columns if c != "_row"])


def clean(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, max_lost_pct: int = 50) -> DataFrame:
    """The documents that pass, with failing lines taken out of ``text`` and
    ``n_chars`` counted anew; all other columns are kept, whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    judged = _verdicts(_packed(docs, rest), min_words, max_repeat_pct, max_lost_pct)
    # the partition number keeps the verdict out of pushed filters, where every rule would be computed again
    judged = judged.withColumn("_keep", F.col("kept") & (F.spark_partition_id() >= 0)).where("_keep")
    out = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)
    return judged.select(*[out.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
