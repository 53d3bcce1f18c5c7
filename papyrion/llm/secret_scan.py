"""Secret scanning with a trigram inverted index: rules become Boolean trigram queries, candidates are verified."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as parser  # the parse tree of a pattern

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules in the order in which ties are listed; the others follow.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # [0-9a-f]+ taken at 32 and more: a run is matched whole or not at all, as its pieces are no run
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def _strings(op, arg, most: int = 16) -> list[str] | None:
    """All texts that one node of a pattern matches, in lower case, or None if there are too many."""
    name = str(op)
    if name == "LITERAL":
        return [chr(arg).lower()]
    if name == "IN":
        if any(str(o) not in ("LITERAL", "RANGE") for o, _ in arg):
            return None
        found = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], min(a[1], a[0] + most) + 1))}
        return sorted(found) if len(found) <= most else None
    if name == "SUBPATTERN":
        return _sequence(arg[3], most)
    if name == "BRANCH":
        parts = [_sequence(x, most) for x in arg[1]]
        return None if any(x is None for x in parts) else sorted({s for x in parts for s in x})
    if name == "MAX_REPEAT" and arg[1] <= 2:
        one = _sequence(arg[2], most)
        return None if one is None else sorted({"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)})
    return None


def _sequence(nodes, most: int = 16) -> list[str] | None:
    found = [""]
    for op, arg in nodes:
        more = _strings(op, arg, most)
        if more is None or len(found) * len(more) > 4 * most:
            return None
        found = [a + b for a in found for b in more]
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What any match holds, in lower case: clauses that all hold, each of alternatives of trigrams that all occur.

    No clause: the pattern forces no trigram, so every text is a candidate.
    """
    clauses, now = [], [""]

    def close(texts: list[str]) -> None:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in texts}
        if grams and frozenset() not in grams:
            # an alternative that asks for more than another adds nothing
            clauses.append(sorted((g for g in grams if not any(o < g for o in grams)), key=sorted))

    for op, arg in parser.parse(pattern):
        more = _strings(op, arg)
        if more is not None and len(now) * len(more) <= 64:
            now = [a + b for a in now for b in more]
        else:
            close(now)
            now = [""]
    close(now)
    return clauses


def row_key(key: Column, text: Column) -> Column:
    """Names a row in the index; equal rows share a name, and a chance clash only adds a candidate."""
    return F.xxhash64(key, text)


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(gram, row)``: postings of every trigram that a rule's query names, over the lower-cased texts."""
    grams = sorted({g for r in rules for c in trigram_query(r.pattern) for alt in c for g in alt})
    low = docs.select(row_key(F.col(key), F.col(text)).alias("row"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("t"), F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("row", F.explode(has).alias("gram")).select("gram", "row")


def candidates(spark: SparkSession, postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(row, kinds)``: rows whose postings satisfy the query of at least one rule."""
    need, clauses = [], []
    for r in rules:
        query = trigram_query(r.pattern)
        if query:
            clauses.append((r.kind, len(query)))
        for c, alts in enumerate(query):
            for a, grams in enumerate(alts):
                need += [(r.kind, c, a, g, len(grams)) for g in sorted(grams)]
    value = lambda rows: ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    wanted = spark.sql(f"select * from values {value(need)} as t(kind, clause, alt, gram, need)")
    total = spark.sql(f"select * from values {value(clauses)} as t(kind, clauses)")
    met = postings.join(F.broadcast(wanted), "gram").groupBy("row", "kind", "clause", "alt", "need").agg(F.count_distinct("gram").alias("n")).where("n = need")
    met = met.groupBy("row", "kind").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(total), "kind").where("n = clauses")
    return met.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


_NONE = "cast(array() as array<struct<start:int,rank:int,kind:string,stop:int>>)"


def _spans(rule: Rule, rank: int, scan: str) -> str:
    """SQL: the rule's spans in ``t`` as structs of start, rank, kind and stop, where ``scan`` holds.

    The pieces between matches and the matches alternate, so their lengths give the offsets.
    """
    lit = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    begin, stop = "a.at + length(get(z.p, k))", "a.at + length(get(z.p, k)) + length(get(z.m, k))"
    span = f"array(named_struct('start', {begin}, 'rank', {rank}, 'kind', '{rule.kind}', 'stop', {stop}))"
    step = f"named_struct('at', {stop}, 'out', if(length(get(z.g, k)) >= {rule.least}, concat(a.out, {span}), a.out))"
    fold = f"aggregate(sequence(0, size(z.m) - 1), named_struct('at', 0, 'out', {_NONE}), (a, k) -> {step}, a -> a.out)"
    parts = f"named_struct('m', regexp_extract_all(t, {lit}, 0), 'p', split(t, {lit}, -1), 'g', regexp_extract_all(t, {lit}, {rule.group}))"
    return f"if({scan} and t rlike {lit}, get(transform(array({parts}), z -> {fold}), 0), {_NONE})"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: an ordered array of start, rank, kind and stop (code points, stop exclusive).

    Null texts have no spans. Rules without a mandatory trigram scan every text; the others scan only
    the rows that the index returns. A column ``spans`` of the input is replaced, all others stay as they are.
    """
    index = cut(build_index(docs, rules, key, text), "postings")
    chosen = cut(candidates(docs.sparkSession, index, rules), "candidates")
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "spans"]).alias("packed"), row_key(F.col(key), F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = [_spans(r, i, f"coalesce(array_contains(kinds, '{r.kind}'), false)" if trigram_query(r.pattern) else "true") for i, r in enumerate(rules)]
    return packed.join(chosen, "row", "left").withColumn("spans", F.expr(f"sort_array(concat({', '.join(parts)}))")).select("packed.*", "spans")


def digest(found: DataFrame, key: str = "doc_id", n_base: int = len(BASE)) -> DataFrame:
    """Counts per base kind, a hash of the base spans and all spans as text."""
    text = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    base = f"filter(spans, x -> x.rank < {n_base})"
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)")
    return found.select(key, *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(F.expr(text.format(base)), 256).alias("base_sha256"), F.expr(text.format("spans")).alias("spans"))
