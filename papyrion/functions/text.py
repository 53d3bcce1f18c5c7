"""Text normalisation, counts, readability, span cleaning and snippets, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrion.functions.rx import every, js_round, let, rx, trim

WORD = r"\b[\w'-]+\b"
#: Words that let a wrapped paragraph go on.
CONJUNCTIONS = "and|or|but|the|a|an|in|on|with|for|to"


def dehyphenate(text: Column) -> Column:
    """Join words that a hyphen splits over a line end."""
    return F.regexp_replace(text, r"([a-z])-\s*\n\s*([a-z])", "$1$2")


def normalize_whitespace(text: Column) -> Column:
    rows = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"\s+\z", ""))
    return trim(F.regexp_replace(F.array_join(rows, "\n"), "\n{3,}", "\n\n"))


def reconstruct_paragraphs(text: Column) -> Column:
    """Join soft-wrapped lines; paragraphs come back separated by one blank line.

    A line starts a paragraph if the line before it is blank, ends with a stop, has up to 40
    characters, or if the line itself starts neither in lower case nor with a conjunction.
    """
    starts = lambda now, last: (
        (last == "") | last.rlike(r"[.!?:,;]\s*\z") | (F.length(last) <= 40) | ~(now.rlike(r"^[a-z]") | now.rlike(rf"(?i)^(?:{CONJUNCTIONS})\s"))
    )
    glue = lambda now, last: F.when(starts(now, F.coalesce(last, F.lit(""))), F.lit("\n\n")).otherwise(F.lit(" "))
    joined = lambda rows: F.transform(rows, lambda x, i: F.when(x == "", F.lit("")).otherwise(F.concat(glue(x, F.get(rows, i - 1)), x)))
    return F.regexp_replace(F.array_join(let(F.transform(F.split(text, "\n"), trim), joined), ""), r"^\n\n", "")


def normalize_text(text: Column) -> Column:
    return reconstruct_paragraphs(normalize_whitespace(dehyphenate(text)))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rx(WORD))).cast("long")


def raw_word_count(text: Column) -> Column:
    """Pieces between white space; differs from :func:`count_words` on symbols."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("long")


def count_syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = F.regexp_replace(w, r"(?:[^laeiouy]es|ed|[^laeiouy]e)\z", "")
    found = F.regexp_count(stem, F.lit("[aeiouy]{1,2}"))
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(found, F.lit(1))).cast("long")


def split_sentences(text: Column) -> Column:
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z0-9])"), trim), lambda x: x != "")


def syllables(text: Column) -> Column:
    """Sum over all words of a text."""
    return F.aggregate(F.transform(every(text, WORD), count_syllables), F.lit(0).cast("long"), lambda a, x: a + x)


def readability(text: Column) -> Column:
    """Struct of Flesch-Kincaid ``score`` (0 to 100) and ``grade`` (at least 0), to one digit."""
    s = F.greatest(F.size(split_sentences(text)), F.lit(1))
    w = F.greatest(count_words(text), F.lit(1))
    y = F.greatest(syllables(text), F.lit(1))

    def make(r: Column) -> Column:
        score = js_round((206.835 - 1.015 * r["ws"] - 84.6 * r["yw"]) * 10) / 10
        grade = js_round((0.39 * r["ws"] + 11.8 * r["yw"] - 15.59) * 10) / 10
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"), F.greatest(F.lit(0.0), grade).alias("grade"))

    return let(let(F.struct(s.alias("s"), w.alias("w"), y.alias("y")), lambda n: F.struct((n["w"] / n["s"]).alias("ws"), (n["y"] / n["w"]).alias("yw"))), make)


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), js_round(words / 220)).cast("long")


def clean_span(span: Column) -> Column:
    """Without the quotes, brackets and stops that cling to both ends."""
    tail = F.regexp_replace(span, r"""["'`)\]}>;:,.!?“”‘’]+\z""", "")
    return F.regexp_replace(tail, r"""^["'`(<\[{;:,.!?“”‘’]+""", "")


def clean_spans(spans: Column) -> Column:
    """Cleaned, empty ones dropped, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(spans, clean_span), lambda x: x != ""))


def provenance(value: Column, text: Column, reach: int = 40) -> Column:
    """The value's first place in the text with its surroundings; null if long or absent."""
    at = F.instr(text, value)
    low = F.greatest(at - reach, F.lit(1))
    stop = F.least(at + F.length(value) + reach, F.length(text) + 1)
    cut = F.concat(F.when(low > 1, "...").otherwise(""), F.substring(text, low, stop - low), F.when(stop <= F.length(text), "...").otherwise(""))
    return F.when((F.length(value) < 100) & (F.length(value) > 0) & (at > 0), cut)


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
