"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch is a table of counts over log-linear bins of whole numbers (values below 128 exactly, larger
ones to one part in 64), so sketches merge by adding counts, in any order and with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.common import cut, words

class Rule(NamedTuple):
    """``value``: the metric in thousandths. Values up to the quantile ``tail`` (in thousandths of the rows)
    are usual; a value fails beyond that by more than ``reach`` times the distance from the median to it.
    Where both coincide ``unit`` counts: what one event moves in the group's median document, or one bin
    of the sketch. ``low``: values below the mirrored quantile fail in the same way."""

    value: str
    tail: int
    reach: int
    unit: str
    low: bool = False


METRICS = {
    "word_length": Rule("(1000 * word_chars) div greatest(n_words, 1L)", 750, 12, "word_length_500 div 64", True),
    "symbols": Rule("(1000 * n_symbols) div greatest(n_words, 1L)", 900, 6, "1000 div greatest(words_500, 1)"),
    "dup_lines": Rule("(1000 * n_dup_lines) div greatest(n_lines, 1L)", 990, 2, "1000 div greatest(lines_500, 1)"),
    "repeats": Rule("(1000 * n_repeat_words) div greatest(n_words, 1L)", 990, 4, "3000 div greatest(words_500, 1)"),
}
#: What is sketched besides: the sizes that the units go by.
SIZES = {"words": "n_words", "lines": "n_lines"}
LEVELS = (250, 500, 750, 900, 990)


@dataclass(frozen=True)
class Params:
    """Groups of fewer than ``min_group`` rows use the sketch of their language, then of all. The base
    rule takes documents of fewer than ``min_words`` words or with more repeated words than allowed."""

    min_group: int = 100
    min_words: int = 50
    max_repeat_percent: int = 50


def stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (long).

    Null texts count as empty. Repeated windows are found by hashes of three words, sorted with their
    positions: no window meets all others. The hashes have 64 bits and are compared whole once sorted, so
    a count is wrong only where two different windows of one text collide.
    """
    d = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("__w", words(F.col("__text")))
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    d = d.withColumn("__h", F.expr("if(n_words < 4, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))))"))
    d = d.withColumn("__bits", F.expr("length(bin(n_words))"))
    packed = "sort_array(transform(__h, (h, i) -> shiftleft(shiftrightunsigned(h, __bits), __bits) | cast(i as bigint)))"
    d = d.withColumn("__s", F.expr(f"if(size(array_distinct(__h)) = size(__h), cast(array() as array<bigint>), {packed})"))
    d = d.withColumn("__at", F.expr("transform(__s, x -> cast(x & (shiftleft(1L, __bits) - 1L) as int))"))
    twin = "((i > 0 and get(__h, get(__at, i - 1)) = get(__h, p)) or get(__h, get(__at, i + 1)) = get(__h, p))"
    d = d.withColumn("__p", F.expr(f"sort_array(filter(__at, (p, i) -> coalesce({twin}, false)))"))
    covered = "aggregate(transform(__p, (p, i) -> least(3, coalesce(get(__p, i + 1) - p, 3))), 0L, (a, x) -> a + x)"
    return d.withColumns(
        {
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.expr(covered),
        }
    ).drop("__text", "__w", "__lines", "__h", "__bits", "__s", "__at", "__p")


def bin_of(value: str) -> Column:
    """The least value of the log-linear bin that holds a whole number of at least 0 (an SQL expression)."""
    return F.expr(f"if({value} < 128, {value}, shiftleft(shiftrightunsigned({value}, length(bin({value})) - 7), length(bin({value})) - 7))")


def sketch(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`stats` with words -> ``(lang, source, metric, bin, n)``. Counts merge by sum."""
    values = {m: r.value for m, r in METRICS.items()} | SIZES
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(sql).alias("v")) for m, sql in values.items()])
    long = rows.where("n_words > 0").select("lang", "source", F.explode(each).alias("x")).select("lang", "source", "x.metric", "x.v")
    return long.select("lang", "source", "metric", bin_of("v").alias("bin")).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Merged sketches by ``keys`` -> ``(keys.., metric, total, q)``: ``q`` has the bins that hold the quantiles of :data:`LEVELS`."""
    merged = counts.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "metric")
    merged = merged.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    at = lambda k: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * k, F.col("bin")))
    return merged.groupBy(*keys, "metric").agg(F.max("total").alias("total"), F.struct(*[at(k).alias(f"q{k}") for k in LEVELS]).alias("q"))


def fences(counts: DataFrame, p: Params = Params()) -> DataFrame:
    """``(lang, source)`` -> one column ``<metric>_lo`` and ``<metric>_hi`` for each metric."""
    own = quantiles(counts, ["lang", "source"])
    lang = quantiles(counts, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("total").alias("lt"), F.col("q").alias("lq"))
    both = quantiles(counts, []).select(F.col("metric").alias("am"), F.col("q").alias("aq"))
    all_ = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).join(F.broadcast(both), F.col("metric") == F.col("am"))  # a row for each metric
    picked = all_.select("lang", "source", "metric", F.when(F.col("total") >= p.min_group, F.col("q")).when(F.col("lt") >= p.min_group, F.col("lq")).otherwise(F.col("aq")).alias("q"))
    wide = picked.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(f"q.q{k}"))).alias(f"{m}_{k}") for m in [*METRICS, *SIZES] for k in LEVELS])
    out = []
    for m, r in METRICS.items():
        out.append(F.expr(f"{m}_{r.tail} + {r.reach} * greatest({m}_{r.tail} - {m}_500, {r.unit})").alias(f"{m}_hi"))
        out.append(F.expr(f"{m}_{1000 - r.tail} - {r.reach} * greatest({m}_500 - {m}_{1000 - r.tail}, {r.unit})" if r.low else "-1L").alias(f"{m}_lo"))
    return wide.select("lang", "source", *out)


def judge(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """``rows`` of :func:`stats` with ``base_failed`` and ``kept``. ``rows`` is read twice: pass a written table.

    Rows fail the base rule with fewer than ``min_words`` words or more repeated words than allowed, and
    the adaptive rules if a metric leaves the fence of the row's language and source (null is a group).
    The fences are written before the join, so that their size is known: they are broadcast only while
    that is small.
    """
    limit = cut(fences(cut(sketch(rows), "sketch"), p), "fences").select(F.col("lang").alias("__l"), F.col("source").alias("__s"), *[f"{m}_{e}" for m in METRICS for e in ("lo", "hi")])
    joined = rows.join(limit, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    base = F.expr(f"n_words < {p.min_words} or 100 * n_repeat_words > {p.max_repeat_percent} * n_words")
    inside = " and ".join(f"({r.value}) between {m}_lo and {m}_hi" for m, r in METRICS.items())
    marked = joined.withColumn("base_failed", base).withColumn("kept", F.expr(f"not base_failed and coalesce({inside}, true)"))
    return marked.select(*rows.columns, "base_failed", "kept")


def report(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Counts and verdict for each document, without its text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = cut(stats(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    return judge(rows, p).select("doc_id", *names, "base_failed", "kept")


def filter_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Clashing column names are kept apart."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "lang", "source", "text")
    rows = cut(stats(packed).drop("text"), "quality")
    return judge(rows, p).where("kept").select("__row.*")
