"""Content dedup, quality, word chunks, vectors and frontier reports."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def first_of_content(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """content_hash, doc of the first document of each content. A null text has no content and is left out."""
    return docs.where(F.col(text).isNotNull()).groupBy(T.content_hash(F.col(text)).alias("content_hash")).agg(F.min(doc).alias("doc"))


def unseen(docs: DataFrame, history: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """First documents whose content is not in history(content_hash)."""
    return first_of_content(docs, doc, text).join(history.select("content_hash"), "content_hash", "left_anti")


def word_chunks(docs: DataFrame, size: int = 50, overlap: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, chunk, text: windows of `size` words, `overlap` shared with the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be within [0, size)")
    step = size - overlap
    words = docs.select(F.col(doc).alias("doc"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+\s*"), F.lit(0)).alias("w"))
    n = F.size("w")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    made = words.where(n > 0).select("doc", F.posexplode_outer(F.transform(F.sequence(F.lit(0), last), lambda i: F.rtrim(F.array_join(F.slice("w", i * step + 1, size), "")))).alias("chunk", "text"))
    return made.select("doc", "chunk", F.regexp_replace("text", r"\s+$", "").alias("text"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(vector: Column, size: int | None = None) -> Column:
    """Finite numbers, not all zero, `size` of them if given; null is not usable."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good & (F.size(vector) == size) if size else good, F.lit(False))


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, score of the k rows nearest to the one vector of query(q); vectors of another size, zero or not finite are left out."""
    fits = (F.size(column) == F.size("q")) & usable(F.col(column)) & usable(F.col("q"))
    both = vectors.crossJoin(F.broadcast(query)).withColumn("score", F.when(fits, cosine(F.col(column), F.col("q")))).where("score is not null")
    return both.select(key, "score").orderBy(F.round("score", 9).desc(), key).limit(k)


#: Phrases of the quality rules, in lower case.
BOILERPLATE = tuple(
    [f"cookie {x}" for x in ("consent", "policy", "preferences")] + [f"terms {x}" for x in ("and conditions", "of use")] + [f"subscribe to {x} newsletter" for x in ("our", "the")]
    + ["all rights reserved", "accept all cookies", "enable javascript", "privacy policy", "verify you are human"]
)
NAVIGATION = ("about us", "contact us", "follow us", "home", "log in", "menu", "next", "previous", "related articles", "search", "share", "sign in", "sign up", "skip to content", "table of contents")
ERROR_TITLES = ("access denied", "forbidden", "internal server error", "just a moment", "request blocked", "service unavailable", "too many requests", "verify you are human")
SOFT_404 = r"^(page (does not exist|not found)|requested page (unavailable|not found)|404(\s*[-:]?\s*(not found|page not found|error))?)[.! ]*$"
#: Texts of fewer words are judged by their first line, too.
LEAD_WORDS = 160
ERROR_PAGE = rf"^({'|'.join(ERROR_TITLES)})[.! ]*$"


@dataclass(frozen=True)
class QualityRules:
    min_characters: int = 300
    min_words: int = 60
    min_unique_words: int = 25
    min_unique_ratio: float = 0.08
    max_boilerplate_ratio: float = 0.65
    max_navigation_ratio: float = 0.65
    max_repeated_line_ratio: float = 0.60
    enabled: bool = True

    def __post_init__(self) -> None:
        if type(self.enabled) is not bool or any(type(x) is not int or x < 1 for x in (self.min_characters, self.min_words, self.min_unique_words)):
            raise ValueError("enabled must be boolean and the least counts positive integers")
        if not all(math.isfinite(x) and 0 <= x <= 1 for x in (self.min_unique_ratio, self.max_boilerplate_ratio, self.max_navigation_ratio, self.max_repeated_line_ratio)):
            raise ValueError("ratios must be within [0, 1]")


#: What `T.WORD` matches, and the white space of Unicode.
_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MENUS = frozenset(NAVIGATION)
_MEASURES = {"characters": pa.int64(), "words": pa.int64(), "unique_words": pa.int64(), "all": pa.int64(), "own": pa.int64(), "boiler": pa.int64(), "nav": pa.int64(), "lead": pa.string()}


def measures(text: str) -> tuple:
    """The values of _MEASURES: counts, characters of all, distinct, boilerplate and menu lines, and the first line of a text short enough for it to matter."""
    words = _WORD.findall(text.lower().replace("ß", "ss"))
    lines = [x for x in (raw.strip(_BLANKS) for raw in text.splitlines()) if x]
    low = [x.lower() for x in lines]
    boiler = sum(len(x) for x, y in zip(lines, low, strict=True) if any(phrase in y for phrase in BOILERPLATE))
    nav = sum(len(x) for x, y in zip(lines, low, strict=True) if y in _MENUS)
    lead = lines[0] if lines and len(words) < LEAD_WORDS else ""
    return len(text.strip(_BLANKS)), len(words), len(set(words)), sum(map(len, lines)), sum(map(len, set(lines))), boiler, nav, lead


def _measured(text: str) -> Column:
    """A struct of _MEASURES, in one pass over each text."""
    kinds = ", ".join(f"{n}: {'string' if pa.types.is_string(k) else 'bigint'}" for n, k in _MEASURES.items())

    @F.arrow_udf(f"struct<{kinds}>")
    def measure(texts: pa.Array) -> pa.Array:
        got = list(zip(*(measures(t.as_py() or "") for t in texts), strict=True)) or [()] * len(_MEASURES)
        return pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(got, _MEASURES.values(), strict=True)], names=list(_MEASURES))

    return measure(F.col(text).cast("string"))


def _ratios(m: Column) -> dict[str, Column]:
    total = F.greatest(F.lit(1), m["all"])
    return {
        "unique_ratio": m["unique_words"] / F.greatest(F.lit(1), m["words"]), "boilerplate_ratio": m["boiler"] / total, "navigation_ratio": m["nav"] / total,
        "repeated_line_ratio": F.when(m["all"] > 0, 1 - m["own"] / total).otherwise(0.0),
    }


def _reason(m: Column, title: str | None, rules: QualityRules) -> Column:
    """The first rule that a document fails, or null."""
    if not rules.enabled:
        return F.lit(None).cast("string")
    heading = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    t, lead, r = F.lower(F.trim(F.split(heading, r"\|")[0])), F.lower(m["lead"]), _ratios(m)

    def looks_like(pattern: str) -> Column:
        return t.rlike(pattern) | (lead.rlike(pattern) & (m["words"] < LEAD_WORDS))

    thin = (m["unique_words"] < rules.min_unique_words) | ((r["unique_ratio"] < rules.min_unique_ratio) & (m["unique_words"] < 2 * rules.min_unique_words))
    return (
        F.when(m["words"] == 0, "empty_content").when(looks_like(SOFT_404), "soft_404").when(looks_like(ERROR_PAGE), "error_page")
        .when((r["boilerplate_ratio"] > rules.max_boilerplate_ratio) | (r["repeated_line_ratio"] > rules.max_repeated_line_ratio), "boilerplate")
        .when(r["navigation_ratio"] > rules.max_navigation_ratio, "navigation_content")
        .when((m["words"] < rules.min_words) & (m["characters"] < rules.min_characters), "too_short").when(thin, "insufficient_content")
    )


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), doc: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """doc, seven metrics and reason (null: accepted; else the first rule that the document fails)."""
    rows = docs.select(F.col(doc).alias("doc"), _measured(text).alias("m"), *([F.col(title).alias("t")] if title else []))
    m = F.col("m")
    return rows.select("doc", "m.characters", "m.words", "m.unique_words", *(c.alias(n) for n, c in _ratios(m).items()), _reason(m, "t" if title else None, rules).alias("reason"))


def accepted(docs: DataFrame, rules: QualityRules = QualityRules(), doc: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """Rows of docs that pass every rule, decided row by row: no join."""
    name = "_m"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, _measured(text)).where(_reason(F.col(name), title, rules).isNull()).drop(name)


def water_fill(pages: DataFrame, total: int, cap: int) -> DataFrame:
    """domain, n: a total spread evenly over domains, in rounds, with a cap for each."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("page_id"))
    taken = pages.withColumn("rn", rank).where(F.col("rn") <= cap).orderBy("rn", "domain").limit(total)
    return taken.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
