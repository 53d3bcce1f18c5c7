"""SimHash fingerprints, exact Hamming links between population-count tiles, and duplicate groups.

Two operators share the method. :func:`near_duplicates` links 64-bit fingerprints within a radius.
:func:`near_copies` links texts by the Jaccard similarity of their shingle sets: fingerprints of 128 bits
find the candidates, the shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.common import bit_mask, cut, masked, small_batches
from papyrion.llm.components import components

SEED = 42
STEP = 1 << 16


def _shingles(text: str | None, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each shingle starts and stops in them."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.cumsum(size + 1) - size - 1
    stop = start + size
    if len(w) > width:
        start, stop = start[: len(w) - width + 1], stop[width - 1 :]
    else:
        start, stop = start[:1], stop[-1:]
    return b" ".join(w), start, stop


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash over word shingles as an unsigned integer; 0 for a text without words."""
    whole, start, stop = _shingles(text, width)
    if not len(start):
        return 0
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(start), STEP):
        a, b = start[k : k + STEP].tolist(), stop[k : k + STEP].tolist()
        h = np.fromiter((digest(whole[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``(key, fp long)``: one row per row; the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, fp long")


def _lanes(x: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit lanes, one row per fingerprint."""
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _blocks(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x sorted by lane counts, the blocks' bounds, and each block's least and most count per lane."""
    lanes = _lanes(x)
    order = np.lexsort((lanes[:, 2], lanes[:, 0]))
    x, lanes = x[order], lanes[order]
    cuts = np.arange(0, len(x), size)
    return x, np.append(cuts, len(x)), np.minimum.reduceat(lanes, cuts), np.maximum.reduceat(lanes, cuts)


def _settle(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union of all pairs (u, v); every entry of the result points at its root."""
    while len(u):
        u, v = parent[u], parent[v]
        apart = u != v
        if not apart.any():
            break
        u, v = np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        parent[u] = v
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return parent


def link_tiles(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 1024, strip: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links at up to ``radius`` bits between two tiles (or inside one), as a forest: node and root.

    Every pair is compared by exclusive-or and bit count, except block pairs whose population counts
    are further apart than the radius, summed over four lanes: these cannot link. Only a spanning
    forest comes back, so a dense tile gives at most one row per fingerprint.
    """
    x, xs, xlo, xhi = _blocks(a, block)
    y, ys, ylo, yhi = (x, xs, xlo, xhi) if b is None else _blocks(b, block)
    shift = 0 if b is None else len(x)
    parent = np.arange(len(x) + (0 if b is None else len(y)))
    for i in range(len(xlo)):
        away = np.maximum(0, np.maximum(xlo[i] - yhi, ylo - xhi[i])).sum(1)
        for j in np.flatnonzero(away <= radius):
            if b is None and j < i:
                continue
            right = y[ys[j] : ys[j + 1]]
            for k in range(xs[i], xs[i + 1], strip):
                left = x[k : min(k + strip, xs[i + 1])]
                p, q = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
                if len(p) and (b is not None or i != j or len(p) > len(left)):
                    parent = _settle(parent, p + k, q + ys[j] + shift)
    values = x if b is None else np.concatenate([x, y])
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return values[moved], values[parent[moved]]


def links(fps: DataFrame, radius: int = 4, tile: int = 65536) -> DataFrame:
    """``fps(fp long)`` distinct -> ``(u, v)``: edges that join all fingerprints within the radius.

    Fingerprints are tiled by the population counts of their two halves (at most 33 x 33 cells, large
    cells cut into tiles of about ``tile``); a tile meets only tiles whose counts differ by no more
    than the radius in sum. The comparison is exact and complete, so its cost is quadratic in the
    number of distinct fingerprints, less what the population counts rule out.
    """
    cell = fps.select("fp", F.bit_count(F.expr("shiftrightunsigned(fp, 32)")).cast("int").alias("hi"), F.bit_count(F.expr("fp & 4294967295L")).cast("int").alias("lo"))
    sizes = {(r["hi"], r["lo"]): r["n"] for r in cell.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # 1089 rows at most
    if not sizes:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    pieces = {c: -(-n // tile) for c, n in sizes.items()}
    many = F.create_map(*[x for (hi, lo), n in sorted(pieces.items()) for x in (F.lit(hi * 64 + lo), F.lit(n))])
    count = lambda c: F.coalesce(F.try_element_at(many, c), F.lit(0))
    tiles = (
        cell.withColumn("cell", F.col("hi") * 64 + F.col("lo"))
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), count(F.col("cell")))).cast("int"))
        .groupBy("cell", "sub")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = cut(tiles, "tiles")
    near = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius and (a, b) > (0, 0)]
    partner = F.concat(
        # the same cell: itself and the later pieces; each neighbouring cell ahead: all pieces
        F.transform(F.sequence(F.col("sub"), count(F.col("cell")) - 1), lambda s: F.struct(F.col("cell").alias("cell2"), s.cast("int").alias("sub2"))),
        F.flatten(
            F.transform(
                F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near]).cast("array<struct<a:int,b:int>>"),
                lambda d: F.when(
                    (F.floor(F.col("cell") / 64) + d["a"]).between(0, 32) & (F.col("cell") % 64 + d["b"]).between(0, 32) & (count(F.col("cell") + d["a"] * 64 + d["b"]) > 0),
                    F.transform(F.sequence(F.lit(0), count(F.col("cell") + d["a"] * 64 + d["b"]) - 1), lambda s: F.struct((F.col("cell") + d["a"] * 64 + d["b"]).alias("cell2"), s.cast("int").alias("sub2"))),
                ).otherwise(F.array().cast("array<struct<cell2:int,sub2:int>>")),
            )
        ),
    )
    left = tiles.select("cell", "sub", "fps", F.explode(partner).alias("to")).select("cell", "sub", "fps", "to.cell2", "to.sub2")
    right = tiles.select(F.col("cell").alias("cell2"), F.col("sub").alias("sub2"), F.col("fps").alias("fps2"))
    same = (F.col("cell") == F.col("cell2")) & (F.col("sub") == F.col("sub2"))
    pairs = left.join(right, ["cell2", "sub2"]).select(F.col("fps"), F.when(~same, F.col("fps2")).alias("fps2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda x: np.asarray(x.values).view(np.uint64)
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                u, v = link_tiles(flat(a), flat(b) if b.is_valid else None, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _grouped(own: DataFrame, distinct: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``own`` with ``component_id``, the least key of all fingerprints that the components join to its own."""
    groups = groups.withColumnRenamed("node", "fp")
    rooted = distinct.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    ids = cut(rooted.join(lowest, "root").select("fp", "component_id"), "ids")
    return own.join(ids, "fp").select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``(key, fingerprint, component_id)``: one row per row.

    ``component_id`` is the least key reachable over links. Texts without words share fingerprint
    zero and link like any other; a null key gets the least known key of its group, if any.
    """
    own = cut(fingerprints(docs, key, text, width), "fp")
    distinct = cut(own.groupBy("fp").agg(F.min(key).alias("least")), "fps")
    found = _grouped(own, distinct, components(links(distinct.select("fp"), radius)), key)
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class Copies:
    """Shingles of ``width`` words, linked at a Jaccard similarity of ``num / den`` or more.

    Two sets of similarity 0.8 are 0.151 * pi apart as vectors, so 19 of 128 bits differ between
    them, with a deviation of 4; unrelated texts differ in 64, with a deviation of 6. ``radius`` lies 3.6 deviations
    above the one and 5.3 below the other. Tiles hold a 64th of all fingerprints, but no fewer than ``tile`` and no more
    than ``most`` (16 MB), so that they are sent to some 64 others each.
    """

    width: int = 5
    num: int = 4
    den: int = 5
    radius: int = 34
    tile: int = 32768
    most: int = 1 << 20


def shingle_digests(text: str | None, width: int = 5) -> set[bytes]:
    """128-bit hashes of a text's different shingles; none for a text without words."""
    whole, start, stop = _shingles(text, width)
    digest = xxhash.xxh3_128_digest
    return {digest(whole[i:j], SEED) for i, j in zip(start.tolist(), stop.tolist(), strict=True)}


def wide_fingerprint(found: set[bytes]) -> bytes:
    """128-bit SimHash over the hashes of a text's shingles: 16 bytes, all zero for none."""
    bits = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)
    ones = np.zeros(128, np.int64)
    for k in range(0, len(bits), STEP):
        ones += np.unpackbits(bits[k : k + STEP], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(bits)).tobytes()


def _forest(n: int, p: np.ndarray, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the pairs (p, q) of n nodes by distance d; its edges are pairs given."""
    parent, out = np.arange(n), []
    order = np.argsort(d, kind="stable")
    p, q, d = p[order], q[order], d[order]
    bounds = np.append(np.flatnonzero(np.diff(d, prepend=-1)), len(d))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        e = np.arange(lo, hi)
        while True:
            u, v = parent[p[e]], parent[q[e]]
            apart = u != v
            if not apart.any():
                break
            e, u, v = e[apart], u[apart], v[apart]
            hooks, at = np.unique(np.maximum(u, v), return_index=True)
            parent[hooks] = np.minimum(u, v)[at]
            out.append(e[at])
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
    kept = np.concatenate(out) if out else np.zeros(0, np.int64)
    return p[kept], q[kept], d[kept]


def nearest_pairs(
    a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 1024, strip: int = 256, most: int = 1 << 21, sizes: np.ndarray | None = None, ratio: tuple[int, int] = (0, 1)
) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning forest of all pairs within ``radius`` bits between two tiles (or inside one) of 128-bit fingerprints.

    ``a`` and ``b`` have two 64-bit words a row; places in ``a`` followed by ``b`` come back. All pairs are compared.
    ``sizes`` of the sets, in the order of the places, leave out pairs whose lesser size is below ``ratio`` of the greater: their
    similarity is lower still, so they must not take the place of others. Those found are thinned to their forest whenever there are more than ``most``, which changes nothing, as the
    forest of a union is within the union of forests.
    """
    right, shift = (a, 0) if b is None else (b, len(a))
    n = len(a) + (0 if b is None else len(b))
    kept, waiting = [], 0
    for k in range(0, len(a), strip):
        x = a[k : k + strip]
        for j in range(k if b is None else 0, len(right), block):
            y = right[j : j + block]
            d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            d += np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
            p, q = np.nonzero(d <= radius)
            if len(p):
                e = d[p, q].astype(np.int16)
                p, q = p + k, q + j + shift
                if b is None:
                    p, q, e = (c[q > p] for c in (p, q, e))
                if sizes is not None:
                    fit = ratio[1] * np.minimum(sizes[p], sizes[q]) >= ratio[0] * np.maximum(sizes[p], sizes[q])
                    p, q, e = p[fit], q[fit], e[fit]
                kept.append((p, q, e))
                waiting += len(p)
                if waiting > most:
                    kept = [_forest(n, *map(np.concatenate, zip(*kept, strict=True)))]
                    waiting = len(kept[0][0])
                    most = max(most, 2 * waiting)
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(n, *map(np.concatenate, zip(*kept, strict=True)))[:2]


def candidates(fps: DataFrame, p: Copies = Copies()) -> DataFrame:
    """``fps(fp binary, ones int, n int)`` distinct -> ``(u, v)``: per pair of tiles a minimum spanning forest of the pairs within the radius.

    ``n`` is the size of the shingle set; pairs whose sizes rule out the similarity are left out before the forest.

    Cells hold 16 population counts each, large ones are cut into tiles; a tile meets those whose
    counts differ by no more than the radius. At this radius that rules out little: the cost is quadratic in
    the number of distinct fingerprints.
    """
    # the size follows the fingerprint in four bytes
    cell = fps.select(F.concat("fp", F.unhex(F.lpad(F.hex("n"), 8, "0"))).alias("fp"), F.expr("ones div 16").cast("int").alias("cell"))
    sizes = {r["cell"]: r["n"] for r in cell.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # 9 rows at most
    if not sizes:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    tile = min(p.most, max(p.tile, sum(sizes.values()) // 64))
    pieces = F.array(*[F.lit(-(-sizes.get(c, 0) // tile)) for c in range(9)])
    tiles = cell.withColumn("sub", F.pmod(F.xxhash64("fp"), F.get(pieces, "cell")).cast("int")).groupBy("cell", "sub").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # sorted: a rerun finds the same forest
    tiles = cut(tiles, "tiles")
    # a cell's counts end 15 above its least, so cells meet up to this many ahead
    ahead = F.sequence(F.col("cell"), F.least(F.lit(8), F.col("cell") + (p.radius + 15) // 16))
    start = lambda c: F.when(c == F.col("cell"), F.col("sub")).otherwise(F.lit(0))
    subs = lambda c: F.when(start(c) < F.get(pieces, c), F.sequence(start(c), F.get(pieces, c) - 1)).otherwise(F.array().cast("array<int>"))
    partner = F.flatten(F.transform(ahead, lambda c: F.transform(subs(c), lambda s: F.struct(c.alias("cell2"), s.alias("sub2")))))
    left = tiles.select("cell", "sub", "fps", F.explode(partner).alias("to")).select("cell", "sub", "fps", "to.cell2", "to.sub2")
    right = tiles.select(F.col("cell").alias("cell2"), F.col("sub").alias("sub2"), F.col("fps").alias("fps2"))
    same = (F.col("cell") == F.col("cell2")) & (F.col("sub") == F.col("sub2"))
    pairs = left.join(right, ["cell2", "sub2"]).select("fps", F.when(~same, F.col("fps2")).alias("fps2"))
    # one comparison of tiles may take minutes: they are dealt out one by one, not by bytes
    count = sum(-(-n // tile) for n in sizes.values())
    pairs = pairs.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, min(10_000, count * (count + 1) // 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                values = [a.as_py(), b.as_py() or []]
                x, y = (np.frombuffer(b"".join(v), [("fp", "<u8", 2), ("n", ">u4")]) for v in values)
                sizes = np.concatenate([x["n"], y["n"]]).astype(np.int64)
                fx, fy = (np.ascontiguousarray(v["fp"]) for v in (x, y))
                u, v = nearest_pairs(fx, fy if b.is_valid else None, p.radius, sizes=sizes, ratio=(p.num, p.den))
                if len(u):
                    both = values[0] + values[1]
                    yield pa.RecordBatch.from_arrays([pa.array([both[i][:16] for i in e.tolist()], pa.binary()) for e in (u, v)], ["u", "v"])

    return pairs.mapInArrow(run, "u binary, v binary").distinct()


BUCKETS = 1 << 17  # the first 17 bits of a shingle's hash


def _ranks(given: DataFrame, width: int) -> np.ndarray:
    """For each bucket of shingle hashes its rank by how often its shingles occur in the corpus, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(seen, (_codes(shingle_digests(t.as_py(), width)) >> np.uint64(47)).astype(np.int64), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["b", "n"])

    counts, ranks = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int32)
    for b, n in given.select("t").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n")).collect():  # BUCKETS rows at most
        counts[b] = n
    ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.int32)
    return ranks


def _codes(found: set[bytes]) -> np.ndarray:
    """The first 64 bits of the hashes."""
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)[:, 0]


def _prefix(found: set[bytes], ranks: np.ndarray, p: Copies) -> np.ndarray:
    """The rarest codes of a set, of which two similar sets share one at least, in order."""
    codes = _codes(found)
    if not len(codes):
        return codes.view(np.int64)
    order = np.lexsort((codes, ranks[(codes >> np.uint64(47)).astype(np.int64)]))
    return codes[order[: len(codes) - -(-p.num * len(codes) // p.den) + 1]].view(np.int64)


def sketch(found: set[bytes]) -> bytes:
    """Parity sketch of a set: for each of two bits a member, rounded up to a power of two and 64 at least, whether an odd number of codes falls there."""
    size = max(64, 1 << (2 * len(found) - 1).bit_length()) if found else 64
    seen = np.bincount((_codes(found) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((seen & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the larger folded to the size of the smaller: never more than members in which the sets do."""
    x, y = sorted((np.frombuffer(v, np.uint64) for v in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sketched(pairs: DataFrame, sketches: DataFrame, on: tuple[str, str], p: Copies) -> DataFrame:
    """Those ``pairs`` whose sketches do not rule out the similarity; ``sketches(id, n, sk)`` has a row for each id in the columns ``on``."""
    one, two = (sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{s}"), F.col("sk").alias(f"s{s}")) for c, s in zip(on, "uv", strict=True))
    both = pairs.join(one, on[0]).join(two, on[1]).select(*pairs.columns, "nu", "su", "nv", "sv")
    width = len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(width + i).to_pylist() for i in range(4)), strict=True)
            fit = [(p.num + p.den) * sketch_distance(su, sv) <= (p.den - p.num) * (nu + nv) for nu, su, nv, sv in rows]
            yield b.select(list(range(width))).filter(pa.array(fit, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


def _across(own: DataFrame, groups: DataFrame, p: Copies) -> DataFrame:
    """``(tu, tv)``: text hashes of all pairs of texts in different groups that may be similar enough.

    Texts meet over the rarest shingles of their sets (prefix filter), subject to the length and positional filters. Shingles
    of one group only, as those of most copies, lead to no pair.
    """
    numbers = cut(groups.select("root").distinct().withColumn("c", F.monotonically_increasing_id()), "numbers")
    known = groups.join(numbers, "root").select("fp", "c")
    # the prefixes are shuffled once, to their groups' numbers
    heads = cut(own.select("fp", "th", "n", "prefix").join(known, "fp").select("c", "th", "n", "prefix"), "heads")
    crossing = heads.select("c", F.explode("prefix").alias("code")).groupBy("code").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    crossing = cut(crossing.where("lo < hi").select("code"), "crossing")
    rows = masked(heads.select("c", "th", "n", F.posexplode("prefix").alias("k", "code")), bit_mask(crossing, "code"), "code").where("maybe").drop("maybe")
    met = rows.join(crossing, "code", "left_semi").repartition("code", "c").groupBy("code", "c").agg(F.collect_set(F.struct("th", "n", "k")).alias("texts"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("k")).alias("rest"))
    met = cut(met, "met")
    one, two = (met.select("code", *[F.col(c).alias(f"{c}{x}") for c in ("c", "texts", "least", "most", "rest")]) for x in "lr")
    # groups of which no two texts can pass the filters below do not meet
    may = f"cl < cr and {p.den} * mostl >= {p.num} * leastr and {p.den} * mostr >= {p.num} * leastl and {p.num + p.den} * least(restl, restr) >= {p.num} * (leastl + leastr)"
    both = one.join(two, "code").where(may).select(F.explode("textsl").alias("l"), "textsr").select("l", F.explode("textsr").alias("r"))
    fit = f"{p.den} * least(l.n, r.n) >= {p.num} * greatest(l.n, r.n) and {p.num + p.den} * least(l.n - l.k, r.n - r.k) >= {p.num} * (l.n + r.n)"
    return both.where(fit).select(F.col("l.th").alias("tu"), F.col("r.th").alias("tv")).distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Copies = Copies()) -> DataFrame:
    """``(key, component_id)``: one row per row; ``component_id`` is the least key reachable over links.

    Texts link if the Jaccard similarity of their shingle sets is at least ``num / den``. First candidates are the nearest pairs of
    128-bit fingerprints, a forest per pair of tiles, so a group of m copies has some m of them and not m * m.
    Where a forest's pair fails or lies beyond the radius, others that pass may have been left out: so all pairs of texts that
    are then in different groups and share one of their rarest shingles are candidates too, which leaves out no link.
    Parity sketches, of which two cannot differ more than their sets, spare most candidates the exchange of sets; each that is left
    is verified on the shingles, told apart by 32-bit hashes (of two texts of 20,000 words, some 0.1
    shingles are taken for another). Texts of one fingerprint are one class. Null texts and texts without words are
    one class too; a null key gets the least known key of its group, if any.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(wide_fingerprint(found), len(found), _prefix(found, ranks, p), sketch(found)) for found in (shingle_digests(t.as_py(), p.width) for t in b.column(1))]
            fps, sizes = [m[0] for m in made], pa.array([m[1] for m in made], pa.int32())
            heads, sketches = pa.array([m[2] for m in made], pa.list_(pa.int64())), pa.array([m[3] for m in made], pa.binary())
            ones = [int.from_bytes(f).bit_count() for f in fps]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.binary()), pa.array(ones, pa.int32()), sizes, heads, sketches], ["k", "th", "fp", "ones", "n", "prefix", "sk"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = np.unique(np.frombuffer(b"".join(d[:4] for d in shingle_digests(b.column(1)[i].as_py(), p.width)), np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), pa.array([found], pa.list_(pa.int32()))], ["k", "th", "s"])

    ranks = _ranks(given, p.width)
    own = cut(given.mapInArrow(prints, f"k {kind}, th long, fp binary, ones int, n int, prefix array<long>, sk binary"), "fp")
    distinct = cut(own.groupBy("fp", "ones").agg(F.min("k").alias("least"), F.min(F.struct("k", "th", "n", "sk")).alias("one")), "fps")
    edges = cut(candidates(distinct.select("fp", "ones", "one.n"), p), "candidates")
    edges = cut(_sketched(edges, distinct.select(F.col("fp").alias("id"), "one.n", "one.sk"), ("u", "v"), p), "near")
    ends = edges.select(F.col("u").alias("fp")).union(edges.select(F.col("v").alias("fp"))).distinct()
    sought = cut(distinct.join(ends, "fp").select("fp", "one.k", F.col("one.th").alias("th")), "sought")
    # texts are not shuffled: the mask finds those that are sought where they lie, their sets are joined
    texts = masked(given, bit_mask(sought, "k", "th"), "k", "th").where("maybe").select("k", "t", "th")
    made = texts.mapInArrow(sets, f"k {kind}, th long, s array<int>").hint("merge")
    # rows that repeat key and text give a set more than once, and links more than once: components count them once
    shingled = cut(made.join(sought, made["k"].eqNullSafe(sought["k"]) & (made["th"] == sought["th"])).select("fp", "s"), "sets")
    # sets grow with the corpus, so no size of theirs is broadcast
    one, two = (shingled.select(F.col("fp").alias(c), F.col("s").alias(f"s{c}")).hint("merge") for c in "uv")
    # the sets are without repeats; they are intersected once, as joins compute a condition's parts as often as it names them
    similar = F.expr(f"{p.num + p.den} * size(array_intersect(su, sv)) >= {p.num} * (size(su) + size(sv))")
    alike = cut(edges.join(one, "u").join(two, "v").where(similar).select("u", "v"), "alike")
    groups = cut(components(alike), "components")
    whole = distinct.select("fp").join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    more = cut(_across(own, whole, p), "across")
    ends_of = lambda pairs: pairs.select(F.col("tu").alias("th")).union(pairs.select(F.col("tv").alias("th"))).distinct()
    ends = cut(ends_of(more), "met-ends")
    found = masked(own.select("th", "n", "sk", "fp"), bit_mask(ends, "th"), "th").where("maybe").join(ends, "th", "left_semi")
    sketches = cut(found.groupBy(F.col("th").alias("id")).agg(F.first("n").alias("n"), F.first("sk").alias("sk"), F.min("fp").alias("fp")), "sketches")
    more = cut(_sketched(more, sketches, ("tu", "tv"), p), "more-near")
    ends = cut(ends_of(more), "ends")
    texts = masked(given, bit_mask(ends, "th"), "th").where("maybe").select("k", "t", "th")
    made = texts.mapInArrow(sets, f"k {kind}, th long, s array<int>").hint("merge").join(ends, "th", "left_semi").groupBy("th").agg(F.first("s").alias("s"))
    shingled = cut(made, "more-sets")
    one, two = (shingled.select(F.col("th").alias(f"t{c}"), F.col("s").alias(f"s{c}")).hint("merge") for c in "uv")
    links_left = cut(more.join(one, "tu").join(two, "tv").where(similar).select("tu", "tv"), "more-alike")
    one, two = (sketches.select(F.col("id").alias(f"t{c}"), F.col("fp").alias(c)) for c in "uv")
    links_left = links_left.join(one, "tu").join(two, "tv").select("u", "v").distinct()
    if not links_left.isEmpty():
        groups = components(alike.union(links_left))
    return _grouped(own.drop("prefix", "sk"), distinct, groups, "k").select(F.col("k").alias(key), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Copies = Copies()) -> DataFrame:
    """The rows of ``docs`` with one document of each group of :func:`near_copies`: that with the least key.

    Of repeated rows of that key the one with the least text hash stays. Rows with a null key cannot
    be told apart by key: all of them stay.
    """
    groups = cut(near_copies(docs, key, text, p).select(F.col(key).alias("k"), "component_id"), "groups")
    gone = cut(groups.where("k <> component_id").select("k").distinct(), "gone")
    again = cut(groups.where("k = component_id").groupBy("k").count().where("count > 1").select("k", F.lit(True).alias("twice")), "again")
    # rows whose key is in neither table stay as they are: the mask finds most of them, so that only the others are joined
    packed = masked(docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k")), bit_mask(gone.union(again.select("k")), "k"), "k")
    known = packed.where("maybe").drop("maybe").join(gone, "k", "left_anti").join(again, "k", "left")
    first = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.col("row").getField(text))))
    once = known.where("twice").withColumn("n", first).where("n = 1").drop("n")
    return packed.where(~F.col("maybe")).select("row").union(known.where("twice is null").select("row")).union(once.select("row")).select("row.*")
