"""WARC archives: a distributed writer with revisit records, and a reader that verifies record chains.

Writing uses Spark's text sink with the record terminator as line separator, so archives land on any
file system Spark can reach and a lost executor only repeats its task. Reading splits files at the
magic line. Every chunk that starts with the magic is a candidate; a task emits the candidate's offset
and the offset of the successor that its Content-Length claims. Pointer jumping from the file's start
then keeps the reachable candidates, so a magic line inside a payload is never taken for a record.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm.common import cut

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def plan_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", min_dedupe: int = 100) -> DataFrame:
    """One row per input row: ``id, uri, payload, n_bytes, digest, first_id`` (null unless it revisits).

    Of rows with equal payloads of at least ``min_dedupe`` bytes the least id responds; rows that
    repeat that id as well respond too. Null payloads are empty; a null id revisits a known response,
    and a group with null ids only has no revisits.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    groups = (
        rows.where(F.col("n_bytes") >= min_dedupe)
        .groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("digest", "first_id")
    )
    first = F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(groups, "digest", "left").select("id", "uri", "payload", "n_bytes", "digest", first.alias("first_id"))


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def write_warc(records: DataFrame, path: str, date: str = EPOCH, compression: str = "gzip") -> None:
    """Write the rows of :func:`plan_records` as WARC files under ``path``, one or more for each partition.

    Compressed archives take a third of the room and are read one file a task; with ``none`` a large
    file is read in splits. Offsets count uncompressed bytes either way.
    """
    again = F.col("first_id").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    content = F.when(again, F.lit("")).otherwise(F.col("payload"))
    value = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", _urn(F.col("first_id"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("X-Payload-Length", F.col("n_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(content).cast("string")),
        F.lit("\r\n"),
        content,
    )
    records.select(value.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def reachable(offsets: np.ndarray, claimed: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Pointer jumping over one file: ``(kept, successor index)`` of the sorted candidate offsets.

    ``claimed`` is the claimed record length, negative if there is none. Successor index n stands for
    the end of the file and n + 1 for a place that holds no record.
    """
    n = len(offsets)
    after = np.where(claimed >= 0, offsets + claimed, -1)
    at = np.searchsorted(offsets, after)
    hit = (at < n) & (offsets[np.minimum(at, n - 1)] == after) if n else np.zeros(0, bool)
    succ = np.where(hit, at, np.where(after == total, n, n + 1))
    kept = np.zeros(n + 2, bool)
    if n and offsets[0] == 0:
        kept[0] = True
        jump, steps = np.append(succ, [n, n + 1]), 1
        while steps <= n:
            kept[jump[np.flatnonzero(kept)]] = True
            jump, steps = jump[jump], steps * 2
    return kept[:n], succ


_CHAIN = "file string, offset long, part string, parts array<string>, complete boolean, type string, rid string, refers string, uri string, head_digest string, head_length long, n_bytes long, digest string"


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """All chunks of one file -> its reachable records. Memory: some hundred bytes per record of the file."""
    rows = rows.sort_values(["block", "mid"], ignore_index=True)
    size = rows["size"].to_numpy(np.int64).copy()
    size[0] -= len(MAGIC)  # what precedes the first magic line
    offset = np.cumsum(size) - size
    kept, succ = reachable(offset[1:], rows["claimed"].fillna(-1).to_numpy(np.int64)[1:], int(size.sum()))
    i = np.flatnonzero(kept)
    out, part = rows.iloc[i + 1].copy(), rows["part"].to_numpy()
    stop = np.minimum(succ[i], len(kept))
    whole = succ[i] <= len(kept)
    out["offset"], out["complete"] = offset[i + 1], whole
    out["parts"] = [part[a + 1 : b + 1].tolist() if w and b > a + 1 else [] for a, b, w in zip(i, stop, whole, strict=True)]
    return out[[c.split()[0] for c in _CHAIN.split(", ")]]


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines. ``block`` and ``mid`` order the chunks of a file within one scan only,
    since splits depend on the cores there are; ``part``, a hash of the content, names a chunk in any scan."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), F.sha2("value", 256).alias("part"), "value"
    )


def _fields(df: DataFrame) -> DataFrame:
    """Header fields of a chunk, its claimed length and the payload if the chunk holds all of it."""
    df = df.withColumn("head", F.substring_index("value", END, 1))
    get = lambda name, tail=r"([^\r\n]*)": F.regexp_extract("head", rf"(?im)^{name}:[ \t]*{tail}", 1)
    number = lambda name: F.expr("try_cast(nullif(x, '') as bigint)".replace("x", f"regexp_extract(head, '(?im)^{name}:[ ]*([0-9]+)', 1)"))
    df = df.withColumn("content", number("Content-Length")).withColumn("skip", F.octet_length("head") + 4)
    return df.select(
        "*",
        (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"),
        (len(MAGIC) + F.col("skip") + F.col("content") + 4).alias("claimed"),
        F.lower(get("WARC-Type")).alias("type"),
        get("WARC-Record-ID", r"<([^>\r\n]*)>").alias("rid"),
        get("WARC-Refers-To", r"<([^>\r\n]*)>").alias("refers"),
        get("WARC-Target-URI").alias("uri"),
        get("WARC-Payload-Digest", r"sha256:([0-9a-f]+)").alias("head_digest"),
        number("X-Payload-Length").alias("head_length"),
    )


def _payload() -> Column:
    return F.expr("substring(cast(value as binary), skip + 1, cast(least(content, 2147483647) as int))")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Reachable records of the archives under ``path``.

    Columns: file, offset, complete (false: the claimed length leads nowhere), type, rid, refers, uri,
    head_digest, head_length (of a revisit's response), n_bytes and digest (SHA-256) of the content
    block, and payload (binary) if asked for. An empty folder gives no rows.
    """
    chunks = _fields(_chunks(spark, path))
    meta = chunks.select("file", "block", "mid", "part", "size", "claimed", "type", "rid", "refers", "uri", "head_digest", "head_length", F.col("content").alias("n_bytes"), F.sha2(_payload(), 256).alias("digest"))
    kept = cut(meta.groupBy("file").applyInPandas(_chain, _CHAIN), "warc")
    long = kept.where(F.size("parts") > 1)
    plain = ["file", "offset", "complete", "type", "rid", "refers", "uri", "head_digest", "head_length", "n_bytes"]
    if not with_payload and long.isEmpty():
        return kept.select(*plain, "digest")
    want = kept if with_payload else long
    own = F.when(F.size("parts") > 1, F.col("parts")).otherwise(F.array("part"))
    place = want.select("file", "offset", F.posexplode(own).alias("k", "part"))
    text = place.join(_chunks(spark, path).select("file", "part", "value"), ["file", "part"])
    # equal chunks of a file share their name, so the set drops what the join repeats
    glued = text.groupBy("file", "offset").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("k", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    body = _fields(glued).select("file", "offset", _payload().alias("payload"))
    done = want.join(body, ["file", "offset"], "left").select(*plain, F.sha2("payload", 256).alias("digest"), "payload")
    if with_payload:
        return done
    return kept.where(F.size("parts") <= 1).select(*plain, "digest").unionByName(done.drop("payload"))


def digest_report(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of records that hold pages."""
    again = F.col("type") == "revisit"
    key = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '([^:]*)$', 1), '') as bigint)")
    return records.select(
        key("rid").alias("page_id"),
        F.when(again, F.col("head_length")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(again, F.col("head_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(again, key("refers")).alias("refers_to"),
    )
