"""Line deduplication as an exact set-similarity join of all lines of a corpus.

Lines with one token set form a class. Classes meet over the rarest tokens of their sets (prefix
filter), subject to the positional and length filters and to bounds from parity sketches of 64 and 128
bits; every remaining pair is verified on the tokens of its lines. A line goes if an earlier line, in order of
document and line number, is similar enough. Until they are verified, tokens are told apart by 64-bit
hashes and token sets by 128-bit ones.

All links between similar classes are found. Lines with one token set are one class and need no links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import GAP, bit_mask, cut, masked

BUCKETS = 1 << 17  # the first 17 bits of a hash
MASK_WORDS = 1 << 16


@dataclass(frozen=True)
class Params:
    """Jaccard similarity of at least ``num / den``. Lines of up to ``short`` distinct tokens meet over
    pairs of prefix tokens, since their single tokens are seldom rare."""

    num: int = 4
    den: int = 5
    short: int = 16


def _literal(values: list[int], kind: str) -> Column:
    """A table of fixed size that travels with the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def rarity(docs: DataFrame, text: str = "text") -> list[int]:
    """For each token hash bucket its rank by how often its tokens occur in the corpus, rarest first."""
    tokens = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP)).alias("w")).where("w <> ''")
    seen = dict(tokens.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 47).cast("int").alias("b")).agg(F.count("*").alias("n")).collect())  # BUCKETS rows at most
    ranks = [0] * BUCKETS
    for rank, b in enumerate(sorted(range(BUCKETS), key=lambda b: (seen.get(b, 0), b))):
        ranks[b] = rank
    return ranks


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, th, line_no, line)`` in lower case; th is a hash of the whole text."""
    lines = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.posexplode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def coded(lines: DataFrame, ranks: list[int]) -> DataFrame:
    """``(key, th, line_no, cs)``: a token's code is its hash with the bucket, the first 17 bits, turned into the bucket's rank, so sorted codes are in order of rarity."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    # rank ^ bucket turns the one into the other; the top bit is flipped as codes are sorted as signed numbers
    table = _literal([signed((rank ^ b ^ BUCKETS >> 1) << 47) for b, rank in enumerate(ranks)], "bigint")
    # without the coalesce codes count as nullable, and sorting them takes twice as long
    code = lambda h: F.coalesce(h.bitwiseXOR(table.getItem(F.shiftrightunsigned(h, 47))), F.lit(0).cast("long"))
    codes = F.transform(F.array_remove(F.split("line", GAP), ""), lambda w: code(F.xxhash64(w)))
    return lines.select("key", "th", "line_no", F.sort_array(F.array_distinct(codes)).alias("cs"))


def sketched(docs: DataFrame, ranks: list[int], p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with tokens: ``ord, key, th, line_no, cid, id2, n, x, y, prefix``. Write it before use: ``ord`` numbers the rows.

    ``cid`` and ``id2`` are hashes of the token set and ``n`` is its size. ``x`` holds for each of 64 bits
    whether an odd number of tokens falls there, ``y`` the same for a half of all tokens, so that ``y``
    and ``x ^ y`` are a sketch of 128 bits. ``prefix`` has the rarest codes.
    """
    keep = F.size("cs") - F.expr(f"cast(({p.num} * size(cs) + {p.den - 1}) div {p.den} as int)") + F.when(F.size("cs") <= p.short, 2).otherwise(1)
    return coded(split_lines(docs, key, text), ranks).select(
        F.monotonically_increasing_id().alias("ord"),
        "key",
        "th",
        "line_no",
        F.xxhash64("cs").alias("cid"),
        F.xxhash64(F.lit(7), "cs").alias("id2"),
        F.size("cs").alias("n"),
        F.expr("aggregate(cs, 0L, (a, c) -> a ^ shiftleft(1L, cast(c & 63 as int)))").alias("x"),
        F.expr("aggregate(cs, 0L, (a, c) -> a ^ shiftleft(shiftright(c, 6) & 1L, cast(c & 63 as int)))").alias("y"),
        F.slice("cs", F.lit(1), keep).alias("prefix"),
    )


def repeated(rows: DataFrame) -> DataFrame:
    """``(cid, id2, first)`` of the token sets that more than one line holds; ``first`` is the place and number of the earliest."""
    sets = rows.groupBy("cid", "id2").agg(F.min(F.struct("key", "th", "line_no", "ord")).alias("first"), F.count("*").alias("m"))
    return sets.where("m > 1").select("cid", "id2", "first")


def _keys(rows: DataFrame, p: Params) -> DataFrame:
    """One row per class and key: ``token, k, ord, n, x``. Key sets of similar classes intersect.

    Two classes of which the larger has up to ``short`` tokens share two tokens of their prefixes (one
    longer than usual), so pairs of tokens are their keys; all others share one, at place ``k``. Sets
    too small to resemble any other have no key.
    """
    edge = -(-p.short * p.num // p.den)  # the least set that can resemble one of more than `short` tokens
    single = f"if(n >= {edge}, transform(slice(prefix, 1, cast(n - (({p.num} * n + {p.den - 1}) div {p.den}) + 1 as int)), (t, i) -> struct(t as token, i as k)), array())"
    pairs = f"if(n <= {p.short}, flatten(transform(prefix, (a, i) -> transform(slice(prefix, i + 2, size(prefix)), b -> struct(xxhash64(a, b) as token, 0 as k)))), array())"
    able = rows.where(f"n * {p.den - p.num} >= {p.num}")
    return able.select("ord", "n", "x", F.explode(F.expr(f"concat({single}, {pairs})")).alias("t")).select("t.token", "t.k", "ord", "n", "x")


def _may_match(p: Params) -> Column:
    """Length, positional and sketch filters between two key rows ``l`` and ``r``.

    Sets that differ in m tokens have sketches that differ in m bits at most.
    """
    small, large, both = "least(l.n, r.n)", "greatest(l.n, r.n)", "(l.n + r.n)"
    return F.expr(
        f"l.ord < r.ord and {p.den} * {small} >= {p.num} * {large} and {p.num + p.den} * least(l.n - l.k, r.n - r.k) >= {p.num} * {both} "
        f"and {p.num + p.den} * bit_count(l.x ^ r.x) <= {p.den - p.num} * {both}"
    )


def candidates(rows: DataFrame, many: DataFrame, p: Params) -> DataFrame:
    """``(a, b)``: classes, by the number of their first line, that share a key and may match.

    The short sketch travels with the keys; the long one is fetched for the pairs that pass it. Only lines
    whose sets may be repeated, by a bit mask, are shuffled to learn which come first.
    """
    first = many.select("cid", "id2", F.col("first.ord").alias("head"))
    told, own = masked(rows, bit_mask(first, "cid", "id2"), "cid", "id2"), ["ord", "n", "x", "prefix"]
    heads = told.where("maybe").join(first, ["cid", "id2"], "left").where("head is null or head = ord").select(own)
    keys = _keys(told.where(~F.col("maybe")).select(own).union(heads), p)
    joined = keys.alias("l").join(keys.alias("r"), F.expr("l.token = r.token") & _may_match(p))
    met = joined.select(F.col("l.ord").alias("a"), F.col("r.ord").alias("b")).distinct()
    one, two = (rows.select(F.col("ord").alias(o), F.col("n").alias(f"n{o}"), F.col("y").alias(f"y{o}"), F.expr("x ^ y").alias(f"z{o}")) for o in "ab")
    return met.join(one, "a").join(two, "b").where(f"{p.num + p.den} * (bit_count(ya ^ yb) + bit_count(za ^ zb)) <= {p.den - p.num} * (na + nb)").select("a", "b")


def _place() -> Column:
    return F.xxhash64("key", "th", "line_no")


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(a, b)`` of the pairs whose token sets are similar enough, the class with the earlier first line first.

    Only first lines of classes with candidates are read again: a bit mask of fixed size over their
    places spares the others, and a join drops what the mask lets through by chance.
    """
    ids = pairs.select(F.col("a").alias("ord")).union(pairs.select(F.col("b").alias("ord"))).distinct()
    first = cut(rows.select("ord", "n", "key", "th", "line_no").join(ids, "ord", "left_semi"), "firsts")
    word = F.shiftrightunsigned(_place(), 6).bitwiseAND(F.lit(MASK_WORDS - 1)).cast("int")
    bit = _place().bitwiseAND(F.lit(63)).cast("int")
    bits = dict(first.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("m")).collect())  # MASK_WORDS rows at most
    mask = _literal([bits.get(w, 0) for w in range(MASK_WORDS)], "bigint")
    maybe = split_lines(docs, key, text).where(F.call_function("shiftrightunsigned", F.get(mask, word), bit).bitwiseAND(F.lit(1).cast("long")) == 1)
    on = maybe["key"].eqNullSafe(first["key"]) & (maybe["th"] == first["th"]) & (maybe["line_no"] == first["line_no"])
    # repeated rows of one key and text hold equal lines
    found = maybe.join(first, on).select("ord", "n", F.struct(first["key"], first["th"], first["line_no"]).alias("at"), "line").groupBy("ord").agg(*[F.first(c).alias(c) for c in ("n", "at", "line")])
    one, two = (found.select(F.col("ord").alias(o), F.col("n").alias(f"n{o}"), F.col("at").alias(f"at{o}"), F.col("line").alias(f"line{o}")) for o in "ab")
    tokens = lambda c: F.array_remove(F.split(c, GAP), "")
    # one mention of the tokens that are shared: joins compute a condition's parts as often as it names them
    similar = F.size(F.array_intersect(tokens("linea"), tokens("lineb"))) * (p.num + p.den) >= F.expr(f"{p.num} * (na + nb)")
    swap = F.col("ata") > F.col("atb")
    return pairs.join(one, "a").join(two, "b").where(similar).select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def matched(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, many, links)``: all lines, the repeated sets, and every pair ``(a, b)`` of similar classes by the number of their first lines, a before b."""
    rows = cut(sketched(docs, rarity(docs, text), p, key, text), "lines")
    many = cut(repeated(rows), "repeated")
    pairs = cut(candidates(rows, many, p), "pairs")
    return rows, many, cut(verified(docs, rows, pairs, p, key, text), "links")


def links(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(class_a, class_b)``: every link between different token sets, once, the earlier one first."""
    rows, _, pairs = matched(docs, p, key, text)
    one, two = rows.select(F.col("ord").alias("a"), F.col("cid").alias("class_a")), rows.select(F.col("ord").alias("b"), F.col("cid").alias("class_b"))
    return pairs.join(one, "a").join(two, "b").select("class_a", "class_b")


def members(rows: DataFrame, many: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(key, th, lines)`` per distinct (key, text) with tokens: for each such line its number, its class, how many other classes that links to, and whether it stays.

    The first line of a class stays if no earlier class links to that; all other lines of the class go.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("head"), F.lit(False).alias("late")), F.struct(F.col("b").alias("head"), F.lit(True).alias("late")))).alias("e")).select("e.*")
    linked = cut(ends.groupBy("head").agg(F.count("*").alias("n_links"), F.max("late").alias("late")), "linked")
    own = rows.select("key", "th", "line_no", "ord", "cid", "id2").join(many, ["cid", "id2"], "left")
    # repeated rows of one key and text hold equal lines at equal places
    here = F.struct("key", "th", "line_no").eqNullSafe(F.struct("first.key", "first.th", "first.line_no"))
    own = own.select("key", "th", "line_no", F.col("cid").alias("class_id"), F.coalesce("first.ord", "ord").alias("head"), (F.col("first").isNull() | here).alias("leads"))
    told = own.join(linked, "head", "left").select(
        "key", "th", F.struct("line_no", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("leads") & ~F.coalesce("late", F.lit(False))).alias("kept")).alias("line")
    )
    return told.groupBy("key", "th").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, th, lines, kept_lines)``, one row per row of ``docs``: its lines with tokens, and the numbers of those that stay.

    Order is by key (null first), then by a hash of the text, then by line number. Rows that repeat
    key and text cannot be told apart: they count once in that order and all get the same answer. A line
    goes if any earlier line is similar enough, whether that one stays or not. Lines without tokens are
    neither listed nor removed.
    """
    found = members(*matched(docs, p, key, text))
    base = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__th"))
    joined = base.join(found, base["__key"].eqNullSafe(found["key"]) & (base["__th"] == found["th"]), "left")
    lines = F.coalesce("lines", F.array().cast("array<struct<line_no:int,class_id:bigint,n_links:bigint,kept:boolean>>"))
    stay = F.transform(F.filter("lines", lambda x: x["kept"]), lambda x: x["line_no"])
    return joined.select(F.col("__key").alias(key), F.col("__th").alias("th"), lines.alias("lines")).withColumn("kept_lines", stay)


def clean_documents(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines gone from ``text``; lines without tokens stay where they are."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    gone = dedup(docs, p, key, text).select(F.col(key).alias("k"), "th", F.transform(F.filter("lines", lambda x: ~x["kept"]), lambda x: x["line_no"]).alias("gone")).where("size(gone) > 0").dropDuplicates(["k", "th"])
    own = F.col("row").getField(text)
    both = packed.join(gone, F.col("row").getField(key).eqNullSafe(F.col("k")) & (F.xxhash64(own) == F.col("th")), "left")
    left = F.array_join(F.filter(F.split(own, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    made = F.when(F.col("gone").isNull(), own).otherwise(left)
    return both.select(*[made.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_kept, n_removed, kept_lines`` and ``lines``, the class and number of links of each line."""
    n, kept = F.size("lines").cast("long"), F.size("kept_lines").cast("long")
    told = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["class_id"].alias("class_id"), x["n_links"].alias("n_links")))
    return dedup(docs, p).select("doc_id", n.alias("n_lines"), kept.alias("n_kept"), (n - kept).alias("n_removed"), "kept_lines", told.alias("lines"))
