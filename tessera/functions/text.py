"""Token grammar, stopwords, content hash and quality metrics as columns; JVM expressions only.

Case folding is lower case with the sharp s spelled out. `nfc` composes texts; it is the only function here
that calls Python, and only texts with a combining mark are sent there.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple("a an and are as at be by for from in is it of on or that the this to was were with".split())
TERM = r"(?:\$|\.)?[\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*(?:\+\+|#)?"
#: White space that may stand between two joined words: all but line ends.
GAP = r"[ \t\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LEXEME = rf"(?s)(?:{TERM})|{GAP}|."
PLAIN, ALNUM, LETTER = r"^[\p{L}\p{N}]+$", r"[\p{L}\p{N}]", r"\p{L}"
WORD = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"


def nfc(text: Column) -> Column:
    """The text in normal form C."""
    @F.pandas_udf("string")
    def compose(part: pd.Series) -> pd.Series:
        return part.str.normalize("NFC")

    return F.coalesce(compose(F.when(text.rlike(r"\p{M}"), text)), text)


def snippets(text: Column, tokens: Sequence[str], most: int = 3, window: int = 100) -> Column:
    """Up to `most` excerpts around the tokens, each looked for after the one before; new lines become spaces. Null text: none."""
    none = F.expr("cast(array() as array<string>)")
    if not tokens:
        return none
    half, content = window // 2, F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(c: Column, acc: Column, token: Column) -> Column:
        pos = F.call_function("locate", token, c["low"], acc["at"] + 1) - 1
        low = F.greatest(F.lit(0), pos - half)
        cut = F.replace(F.substring(c["text"], low + 1, pos + half - low), F.lit("\n"), F.lit(" "))
        return F.when(pos < 0, acc).otherwise(F.struct((pos + F.char_length(token)).alias("at"), F.concat(acc["out"], F.array(cut)).alias("out")))

    both = F.array(F.struct(content.alias("text"), F.lower(content).alias("low")))  # computed once
    found = F.transform(both, lambda c: F.aggregate(F.array(*map(F.lit, tokens)), start, lambda acc, t: step(c, acc, t)))
    return F.slice(F.get(found, F.lit(0))["out"], 1, most)


def folded(text: Column) -> Column:
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def lexemes(text: Column) -> Column:
    """Every character of the folded text, as terms, runs of blanks and single others."""
    return F.regexp_extract_all(folded(text), F.lit(LEXEME), F.lit(0))


def tokens_of(lex: Column, stopwords: tuple[str, ...] = STOPWORDS, keep_stopwords: bool = False) -> Column:
    """Tokens (with repeats) from lexemes: terms, parts of compound terms, and joined neighbours."""
    stop = list(stopwords)
    terms = F.filter(lex, lambda x: x.rlike(ALNUM))
    compound = F.filter(terms, lambda t: t.rlike(r"^[\p{L}\p{N}].*[._-].*[\p{L}\p{N}]$") & t.rlike(LETTER))
    aliases = F.flatten(F.transform(compound, lambda t: F.array_distinct(F.concat(F.split(t, "[._-]"), F.array(F.regexp_replace(t, "[._-]", ""))))))

    def joined(a: Column, gap: Column, b: Column) -> Column:
        fits = a.rlike(PLAIN) & b.rlike(PLAIN) & gap.rlike(f"^{GAP}$") & (a != b) & ~a.isin(stop) & ~b.isin(stop)
        fits = fits & (F.char_length(a) >= 2) & (F.char_length(b) >= 2) & (F.char_length(a) + F.char_length(b) <= 48)
        return F.when(fits & F.concat(a, b).rlike(LETTER), F.concat(a, b))

    n = F.greatest(F.size(lex), F.lit(1))
    near = F.zip_with(lex, F.slice(lex, 2, n), lambda a, g: F.struct(a.alias("a"), g.alias("g")))
    pairs = F.filter(F.zip_with(near, F.slice(lex, 3, n), lambda x, b: F.when(x["a"].isNotNull() & x["g"].isNotNull() & b.isNotNull(), joined(x["a"], x["g"], b))), lambda x: x.isNotNull())
    every = F.concat(terms, aliases, pairs)
    return every if keep_stopwords else F.filter(every, lambda t: ~t.isin(stop))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 256)


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def one_line(text: Column) -> Column:
    """White space collapsed; null for nothing."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def without_stopwords(query: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """A query's words, split at white space, less the stopwords, whatever their case."""
    words = F.filter(F.split(F.coalesce(query, F.lit("")), r"(?U)\s+"), lambda w: (w != "") & ~F.lower(w).isin(list(stopwords)))
    return F.array_join(words, " ")


def citations(answer: Column) -> Column:
    """The distinct source numbers cited as [1] or [1, 2], ascending."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.try_cast("int"))))))


def is_grounded(answer: Column, n_sources: Column) -> Column:
    """The answer cites a source at least, only sources that exist, and holds no URL."""
    cited = citations(answer)
    return (F.size(cited) > 0) & F.forall(cited, lambda n: F.coalesce((n >= 1) & (n <= n_sources), F.lit(False))) & ~F.lower(answer).rlike(r"https?://|www\.")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))
