"""Mixing sources to target weights over a domain-language-source tree of token budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.common import WORD, cut

#: A document's domain in the synthetic tables: its source's number modulo four.
DOMAIN = "concat('d', cast(coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint), 0) % 4 as string))"


@dataclass(frozen=True)
class Params:
    """Integer weights by level; what a level does not list weighs ``other``. ``share`` is the budget in
    thousandths of all tokens, ``max_epochs`` how often a leaf may be read, ``seed`` orders its epochs."""

    weights: Sequence[Mapping[str, int]] = field(default_factory=lambda: ({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 6, "fr": 2, "de": 1, "es": 1}, {}))
    other: int = 1
    share: int = 750
    max_epochs: int = 2
    seed: int = 17

    def __post_init__(self):
        if min([self.other, self.max_epochs, *[w for level in self.weights for w in level.values()]]) < 1 or self.share < 0:
            raise ValueError("weights and epochs are whole numbers of at least 1; leave out sources that are not wanted")


LEVELS = ("domain", "lang", "source")


def _weight(level: int, p: Params) -> Column:
    known = p.weights[level]
    if not known:
        return F.lit(p.other).cast("long")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv]), F.col(LEVELS[level])), F.lit(p.other)).cast("long")


def _pour(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes(parents.., name, weight, cap, pool)`` -> adds ``budget``: the parent's pool by weight, no child over its cap.

    Children in order of cap / weight: those whose fair share exceeds the cap take the cap, the rest
    split what is left by weight. What one child cannot use thus goes to its siblings.
    """
    one = [*parents] or [F.lit(0)]
    order = Window.partitionBy(*one).orderBy((F.col("cap") / F.col("weight")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = nodes.withColumn("left", F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("mass", F.sum("weight").over(rest))
    n = n.withColumn("open", F.col("cap") * F.col("mass") > F.col("weight") * F.col("left"))
    # the first open child fixes the rate for itself and all after it
    rate = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col(name).alias("n"), "left", "mass"))).over(Window.partitionBy(*one))
    n = n.withColumn("rate", rate)
    here = F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col(name).alias("n"))
    bound = F.struct(F.col("rate.r").alias("r"), F.col("rate.n").alias("n"))
    budget = F.when(F.col("rate").isNull() | (here < bound), F.col("cap")).otherwise(F.expr("(weight * rate.left) div rate.mass"))
    return n.withColumn("budget", budget).drop("left", "mass", "open", "rate")


def budgets(leaves: DataFrame, p: Params) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` -> adds ``budget``: tokens to take from each leaf.

    The total flows down the tree by weight. A node short of tokens leaves them to its siblings; only
    what a whole family cannot use reaches the siblings of its parent.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * p.max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.expr(f"(sum(tokens) * {p.share}) div 1000").alias("pool"))
    top = _pour(domains.crossJoin(F.broadcast(total)).withColumn("weight", _weight(0, p)), [], "domain")
    mid = langs.join(top.select("domain", F.col("budget").alias("pool")), "domain").withColumn("weight", _weight(1, p))
    mid = _pour(mid, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("pool"))
    low = leaves.join(mid, ["domain", "lang"]).withColumn("weight", _weight(2, p))
    return _pour(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", "budget")


def epoch_key(seed: int, epoch: Column, key: Column) -> Column:
    """The place of a document in an epoch of its leaf: equal keys share it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def leaf_columns(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """``docs`` with ``__domain, __lang, __source, __tokens``; null names count as empty ones."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.withColumns(
        {"__domain": blank(F.expr(domain)), "__lang": blank(F.col("lang")), "__source": blank(F.col("source")), "__tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")}
    )


def cut_points(rows: DataFrame, p: Params) -> DataFrame:
    """``rows(key, domain, lang, source, tokens)`` -> per leaf ``tokens, budget, epochs, last``.

    A leaf yields ``epochs`` whole passes and, of the next epoch's order, the documents up to ``last``:
    the longest prefix within the rest of the budget. Prefix sums run over 4096 ranges of the order
    first, so that only one range of a leaf is ever sorted in one task.
    """
    leaf = [*LEVELS]
    # the tree's leaves are few beside the rows; both uses below read the same small table
    plan = cut(budgets(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), p).withColumns({"epochs": F.expr("coalesce(budget div nullif(tokens, 0), 0L)"), "rest": F.expr("budget - tokens * coalesce(budget div nullif(tokens, 0), 0L)")}), "leaves")
    placed = rows.join(plan.select(*leaf, "epochs", "rest"), leaf).withColumn("place", epoch_key(p.seed, F.col("epochs"), F.col("key")))
    placed = placed.select(*leaf, "tokens", "rest", "place", F.substring("place", 1, 3).alias("range"))
    sums = placed.groupBy(*leaf, "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    order = Window.partitionBy(*leaf).orderBy("range")
    sums = sums.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = sums.where(F.col("upto") > F.col("rest")).groupBy(*leaf).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("base"))).alias("edge"))
    edge = edge.select(*leaf, "edge.range", "edge.base")
    inside = placed.join(edge, [*leaf, "range"]).groupBy(*leaf, "range", "base", "rest", "place").agg(F.sum("tokens").alias("n"))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).groupBy(*leaf).agg(F.max("place").alias("place"))
    found = edge.join(last, leaf, "left").select(*leaf, F.coalesce("place", "range").alias("last"))
    return plan.join(found, leaf, "left").select(*leaf, F.col("tokens").alias("leaf_tokens"), "budget", "epochs", F.coalesce("last", F.lit("g")).alias("last"))


def copies(docs: DataFrame, p: Params = Params(), key: str = "doc_id", domain: str = DOMAIN) -> DataFrame:
    """``docs`` with ``__domain, __lang, __source, __tokens`` and ``__copies``: how often the mixture takes each row.

    Rows with equal keys, null ones among them, have one place in a leaf's order and are taken or left
    together. Texts without words cost nothing. An empty table stays empty. Columns of the input with
    these five names are replaced here; :func:`mix` keeps all columns of its input.
    """
    names = [f"__{c}" for c in LEVELS]
    rows = leaf_columns(docs.drop(*names, "__tokens", "__copies"), domain)
    slim = cut(rows.select(F.col(key).alias("key"), *[F.col(f"__{c}").alias(c) for c in LEVELS], F.col("__tokens").alias("tokens")), "tokens")
    # written, so that the size is known before the join: leaves are broadcast only while they are few
    points = cut(cut_points(slim, p), "points").select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.struct("epochs", "last").alias("__copies"))
    full = rows.join(points, names)
    once = (epoch_key(p.seed, F.col("__copies.epochs"), F.col(key)) <= F.col("__copies.last")).cast("int")
    return full.withColumn("__copies", (F.col("__copies.epochs") + once).cast("int"))


def mix(docs: DataFrame, p: Params = Params(), key: str = "doc_id", domain: str = DOMAIN) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as :func:`copies` says."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), "text", "lang", "source")
    rows = copies(packed, p, "key", domain).where("__copies > 0")
    if p.max_epochs > 1:
        rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select("row.*")
