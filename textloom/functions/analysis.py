"""Analysis of text columns into token arrays, as Column expressions.

The standard tokenizer keeps letters, digits and underscores together, joins letters across one of . : ' and digits across one
of , ; . ', takes Han and Hiragana characters one by one and runs of South-East Asian scripts as one token. Tokens above MAX_LENGTH
characters are dropped but take a position. Filters run after positions are set, so a removed word leaves a gap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import batches

MAX_LENGTH = 255
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())

_ASIAN = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
_SINGLE = r"\p{IsHan}\p{IsHiragana}"
_LETTER = rf"[[\p{{L}}\p{{M}}]&&[^{_ASIAN}{_SINGLE}]]"
_ANY = rf"[[\p{{L}}\p{{M}}\p{{N}}_]&&[^{_ASIAN}{_SINGLE}]]"


def _pattern(x: str, le: str, de: str) -> str:
    """A lazy run up to each joint, as a greedy one would take the character that the joint starts with."""
    return rf"(?:{x}*?(?:{le}(?:[:.'’·]{le})+|{de}(?:[,;.'’]{de})+))+{x}*|{x}+"


TOKEN = rf"[{_SINGLE}]|[{_ASIAN}]+|" + _pattern(_ANY, _LETTER, r"\p{N}")
#: The same for engines without character-class intersection, for scripts that set words apart.
SQL_TOKEN = _pattern(r"[\p{L}\p{M}\p{N}_]", r"[\p{L}\p{M}]", r"\p{N}")
#: For texts without characters of SCRIPTS, whose rules are the only ones that need intersections; ASCII stands first as it is tested fastest.
_FAST = _pattern(r"[a-zA-Z0-9_\p{L}\p{M}\p{N}]", r"[a-zA-Z\p{L}\p{M}]", r"[0-9\p{N}]")
SCRIPTS = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u19E0-\u19FF\u2E80-\u9FFF\uA9E0-\uAADF\uF900-\uFAFF\x{1B000}-\x{1B16F}\x{1F200}\x{20000}-\x{3FFFF}]"


def token_type(term: Column) -> Column:
    """Type of a raw token."""
    return (
        F.when(term.rlike(rf"^[{_ASIAN}]"), "<SOUTHEAST_ASIAN>")
        .when(term.rlike(r"^\p{IsHan}$"), "<IDEOGRAPHIC>")
        .when(term.rlike(r"^\p{IsHiragana}$"), "<HIRAGANA>")
        .when(term.rlike(r"^\p{IsKatakana}+$"), "<KATAKANA>")
        .when(term.rlike(r"^\p{IsHangul}+$"), "<HANGUL>")
        .when(term.rlike(r"\p{L}"), "<ALPHANUM>")
        .otherwise("<NUM>")
    )


def raw_tokens(text: Column) -> Column:
    """Array of raw tokens; nulls give none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = F.when(text.rlike(SCRIPTS), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(_FAST), F.lit(0)))
    return F.filter(found, lambda t: t.rlike(r"[a-zA-Z0-9\p{L}\p{N}]"))


def once(column: Column) -> Column:
    """The column, so marked that Catalyst doesn't copy it: filters on what is made of it, such as those that an explode infers, would analyse each text again.

    A condition that is always true, but not deterministic by its form, keeps projections and filters from being merged with it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


@dataclass(frozen=True)
class Analyzer:
    """Text to array<struct<term,pos>>.

    raw gives the array of raw tokens of a value; keep, if any, decides over terms after lower-casing.
    """

    raw: Callable[[Column], Column] = raw_tokens
    lower: bool = True
    stop: tuple[str, ...] = STOP_WORDS
    keep: Callable[[Column], Column] | None = None
    max_length: int | None = MAX_LENGTH

    def tokens(self, value: Column, many: bool = False) -> Column:
        """many: the value is an array of texts; positions run on from one to the next."""
        raw = F.flatten(F.transform(F.coalesce(value, F.array()), self.raw)) if many else self.raw(value)
        out = F.transform(raw, lambda t, i: F.struct((F.lower(t) if self.lower else t).alias("term"), i.alias("pos")))

        return once(F.filter(out, lambda t: self.accepts(t["term"])))

    def accepts(self, term: Column) -> Column:
        """Whether the filters let a term through."""
        ok = F.char_length(term) <= self.max_length if self.max_length else F.lit(True)
        if self.stop:
            ok = ok & ~term.isin(*self.stop)
        return ok & self.keep(term) if self.keep else ok

    def words(self, text: str) -> list[str]:
        """Terms of one text, on the driver: for queries. By the same tokenizer for the scripts that both know; where the analyzer has a column function of its own, by that."""
        if self.keep or self.raw not in (raw_tokens, whole, blanks):
            return words_of(self, text)
        import regex

        pattern = TOKEN
        for name in ("Thai", "Lao", "Myanmar", "Khmer", "Han", "Hiragana"):
            pattern = pattern.replace(f"\\p{{Is{name}}}", f"\\p{{{name}}}")
        if self.raw is raw_tokens:
            found = [t for t in regex.findall(f"(?V1){pattern}", text) if regex.search(r"[\p{L}\p{N}]", t)]
        elif self.raw is whole:
            found = [text] if text else []
        elif self.raw is blanks:
            found = [t for t in regex.split("[ \t\r\n]+", text) if t]
        found = [t.lower() if self.lower else t for t in found]
        return [t for t in found if (not self.max_length or len(t) <= self.max_length) and t not in self.stop]


def words_of(analyzer: Analyzer, text: str) -> list[str]:
    """Terms of a text by the analyzer's own expressions, so that queries and indexes can't differ; one row, which the driver evaluates itself."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    row = spark.range(1).select(analyzer.tokens(F.lit(text)).alias("t"))
    return [t["term"] for t in row.first()["t"]]


def whole(value: Column) -> Column:
    """The value as one token, for fields that aren't tokenized; empty values have none."""
    return F.filter(F.array(value.cast("string")), lambda t: t.isNotNull() & (t != ""))


def blanks(value: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(value.cast("string"), F.lit("")), "[ \t\r\n]+"), lambda t: t != "")


STANDARD = Analyzer()
PLAIN = Analyzer(stop=())
KEYWORD = Analyzer(whole, lower=False, stop=(), max_length=None)
WHITESPACE = Analyzer(blanks, stop=(), max_length=None)


def token_rows(df: DataFrame, doc_id: str, text: str, analyzer: Analyzer = STANDARD) -> DataFrame:
    """``(doc_id, pos, term)`` of a table's texts; those of the standard tokenizer are taken apart in batches."""
    if analyzer.raw is not raw_tokens:
        rows = df.select(F.col(doc_id).alias("doc_id"), F.explode(analyzer.tokens(F.col(text))).alias("t"))
        return rows.select("doc_id", "t.pos", "t.term")
    rows = batches.tokens(df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")), analyzer.lower, analyzer.stop, analyzer.max_length)
    return rows.where(analyzer.keep(F.col("term"))) if analyzer.keep else rows


def offsets(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, pos, raw, start, end)`` of raw tokens, offsets in characters."""
    rows = batches.tokens(df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")), False, (), None, places=True)
    return rows.withColumnRenamed("term", "raw")
