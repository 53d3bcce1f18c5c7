"""Relational operations over results: history, corrections, annotations, search, counts and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.classify import label
from papyrion.functions.rx import js_round

HISTORY_LIMIT = 20


def newest(versions: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last version of each key. Aggregates before it shuffles, so a hot key costs no more than others."""
    rest = [c for c in versions.columns if c not in (key, order)]
    best = versions.groupBy(key).agg(F.max_by(F.struct(order, *rest), F.col(order)).alias("__v"))
    return best.select(key, *[F.col(f"__v.{c}").alias(c) for c in versions.columns if c != key])


def upsert(history: DataFrame, added: DataFrame, key: str = "id", order: str = "seq", limit: int = HISTORY_LIMIT) -> DataFrame:
    """History after adding documents: the same id replaces and moves to the front, the newest stay."""
    return newest(history.unionByName(added), key, order).orderBy(F.desc(order), key).limit(limit)


def remove(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


HISTORY = "id string, filename string, detectedType string, classificationConfidence double, fileSizeBytes double, extractedAt string, completenessScore double, ocrUsed boolean"


def rehydrate(raw: DataFrame, now: str, text: str = "json", order: str = "seq") -> DataFrame:
    """Stored documents from JSON lines: rows without an id go, the first of an id stays, bad fields get defaults."""
    row = F.from_json(F.col(text), HISTORY, {"mode": "PERMISSIVE"})
    parsed = raw.select(F.col(order), row.alias("d")).select(order, "d.*").where(F.length("id") > 0)
    first = parsed.groupBy("id").agg(F.min_by(F.struct(*parsed.columns), F.col(order)).alias("v")).select("v.*")
    fill = {"filename": "unknown", "detectedType": "general", "classificationConfidence": 0.0, "fileSizeBytes": 0.0, "extractedAt": now, "completenessScore": 0.0, "ocrUsed": False}
    return first.select(order, "id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()])


def current_corrections(log: DataFrame) -> DataFrame:
    """``log(doc_id, field_key, value, corrected_at)`` -> the last value of each field; a null value removes."""
    last = log.groupBy("doc_id", "field_key").agg(F.max_by(F.struct("value"), F.col("corrected_at")).alias("v"), F.max("corrected_at").alias("corrected_at"))
    return last.select("doc_id", "field_key", F.col("v.value").alias("value"), "corrected_at").where("value is not null")


def effective_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that differ from the extracted value; the others are withdrawn."""
    own = fields.select("doc_id", F.col("key").alias("field_key"), F.col("value").alias("__original"))
    joined = corrections.join(own, ["doc_id", "field_key"], "left")
    return joined.where(~F.col("value").eqNullSafe(F.col("__original"))).drop("__original")


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """``fields(doc_id, key, value, ..)`` with corrected values and ``edited``."""
    c = corrections.select("doc_id", F.col("field_key").alias("key"), F.col("value").alias("__new"))
    joined = fields.join(c, ["doc_id", "key"], "left")
    return joined.withColumns({"edited": F.col("__new").isNotNull(), "value": F.coalesce("__new", "value")}).drop("__new")


def annotations_of(rows: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the texts of their annotations in order of creation; an empty array if there are none."""
    notes = annotations.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "text"))), lambda x: x["text"]).alias("notes"))
    return rows.join(notes, keys, "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def search(docs: DataFrame, query: str = "", kind: str = "all", filename: str = "filename", type_: str = "detected_type") -> DataFrame:
    """Documents whose file name or type label contains the query, of one type or all."""
    q = query.lower()
    out = docs if not q else docs.where(F.contains(F.lower(filename), F.lit(q)) | F.contains(F.lower(label(F.col(type_))), F.lit(q)))
    return out if kind == "all" else out.where(F.col(type_) == kind)


def type_breakdown(docs: DataFrame, order: str = "seq", type_: str = "detected_type", top: int = 5) -> DataFrame:
    """The most frequent types; of equal ones that seen first."""
    counts = docs.groupBy(type_).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(top)


def count_per_type(docs: DataFrame, type_: str = "detected_type") -> DataFrame:
    return docs.groupBy(type_).agg(F.count("*").alias("n"))


def kpis(docs: DataFrame, order: str = "seq", type_: str = "detected_type", score: str = "completeness") -> DataFrame:
    """Number of documents, types shown, mean completeness and the most frequent type, in one row."""
    per = docs.groupBy(type_).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.min(order).alias("first_seen"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"),
        F.least(F.lit(5), F.count("*")).cast("long").alias("n_types"),
        js_round(F.sum("s") / F.sum("n")).cast("long").alias("avg_completeness"),
        F.max_by(F.col(type_), F.struct(F.col("n"), -F.col("first_seen"))).alias("most_common"),
    )


def trend(docs: DataFrame, order: str = "seq", name: str = "filename", score: str = "completeness", n: int = 10) -> DataFrame:
    """The newest documents from old to new, with short names; nothing for fewer than two."""
    last = docs.orderBy(F.desc(order)).limit(n)
    many = Window.partitionBy(F.lit(0))  # ten rows at most
    return last.withColumn("__n", F.count("*").over(many)).where("__n >= 2").orderBy(order).select(order, F.substring(name, 1, 12).alias("name"), F.col(score).alias("score"))


def age_bucket(hours: Column) -> Column:
    return F.when(hours < 24, "Today").when(hours < 168, "Earlier this week").otherwise("Older")


def recent(docs: DataFrame, as_of: Column, key: str = "id", order: str = "seq", at: str = "extracted_at", n: int = 8) -> DataFrame:
    """The first documents of the history, each id once, by age."""
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 3600
    return newest(docs, key, order).orderBy(F.desc(order)).limit(n).withColumn("bucket", age_bucket(hours))


def lookup(docs: DataFrame, value, key: str = "id") -> DataFrame:
    return docs.where(F.col(key) == F.lit(value))


def row_search(rows: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any column contains the query, whatever its case; null never does."""
    if not query.strip():
        return rows
    cells = F.array(*[F.lower(F.col(c).cast("string")) for c in columns or rows.columns])
    return rows.where(F.exists(cells, lambda x: F.coalesce(F.contains(x, F.lit(query.lower())), F.lit(False))))


def sort_rows(rows: DataFrame, keys: list[tuple[str, str, bool]]) -> DataFrame:
    """Rows by (column, type, descending); currency and number cells compare as numbers, nulls come last."""
    typed = lambda c, t: F.regexp_replace(F.col(c).cast("string"), r"[^0-9.\-]", "").try_cast("double") if t in ("currency", "number") else F.col(c)
    return rows.orderBy(*[(typed(c, t).desc_nulls_last() if d else typed(c, t).asc_nulls_last()) for c, t, d in keys])


def numeric_columns(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """``column, n_numeric`` of currency and number columns with two or more numbers; an empty cell counts as 0."""
    fit = [c for c, t in types.items() if t in ("currency", "number")]
    is_number = lambda c: F.col(c).isNotNull() & ((F.trim(F.col(c).cast("string")) == "") | F.trim(F.col(c).cast("string")).try_cast("double").isNotNull())
    if not fit:
        return rows.sparkSession.sql("select '' as column, 0L as n_numeric where false")
    one = rows.agg(*[F.count(F.when(is_number(c), 1)).alias(c) for c in fit])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_numeric")) for c in fit])).alias("r")).select("r.*").where("n_numeric >= 2")


def chart_series(rows: DataFrame, types: dict[str, str], numeric: str, order: str, n: int = 50) -> DataFrame:
    """Label and value of the first rows: the first text column, else the first, by a numeric one."""
    text = next((c for c, t in types.items() if t == "text"), next(iter(types)))
    return rows.orderBy(order).limit(n).select(order, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(numeric).cast("double"), F.lit(0.0)).alias("value"))


def field_filter(fields: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return fields.where(F.contains(F.lower("label"), q) | F.coalesce(F.contains(F.lower("value"), q), F.lit(False)))


def coverage(fields: DataFrame) -> DataFrame:
    """Per document the fields, those with a value, and of these the unsure ones."""
    has_value = F.col("value").isNotNull()
    return fields.groupBy("doc_id").agg(
        F.count("*").alias("n_fields"),
        F.count(F.when(has_value, 1)).alias("n_filled"),
        F.count(F.when(has_value & (F.col("confidence") == "low"), 1)).alias("n_low"),
    )


def is_low(confidence: Column) -> Column:
    return confidence < 40


def all_insights(own: DataFrame, generated: DataFrame) -> DataFrame:
    """Computed observations first, then generated ones."""
    a = own.withColumns({"source": F.lit(0), "ai_generated": F.lit(False)})
    b = generated.withColumns({"source": F.lit(1), "ai_generated": F.lit(True)})
    return a.unionByName(b, allowMissingColumns=True)


def insights_by_category(rows: DataFrame) -> DataFrame:
    """Per document and category the number of observations and the place of the first."""
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.min(F.struct("source", "pos")).alias("first_place")).select("doc_id", "category", "n", "first_place.source", "first_place.pos")


def severity_counts(rows: DataFrame) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}")
    return rows.groupBy("doc_id").agg(count("info"), count("notice"), count("warning"))


def insight_targets(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """``rows(doc_id, pos, body)`` and ``tables(doc_id, table_idx, id, title, n_rows)`` -> ``target``.

    Bodies that speak of totals point at the last row of the line items, those that speak of gaps at
    the first row of the experience, written as table index, hyphen, row.
    """
    body = F.lower("body")
    money, gap = body.rlike("reconcil|total"), body.rlike("gap|employment")
    item = F.contains(F.col("id"), F.lit("line")) | F.contains(F.lower("title"), F.lit("line item"))
    job = F.contains(F.col("id"), F.lit("experience")) | F.contains(F.lower("title"), F.lit("experience"))
    per = tables.groupBy("doc_id").agg(F.min(F.when(item, F.struct("table_idx", "n_rows"))).alias("items"), F.min(F.when(job, F.col("table_idx"))).alias("jobs"))
    joined = rows.join(per, "doc_id", "left")
    target = F.coalesce(
        F.when(money & F.col("items").isNotNull(), F.concat_ws("-", F.col("items.table_idx").cast("string"), F.greatest(F.col("items.n_rows") - 1, F.lit(0)).cast("string"))),
        F.when(gap & F.col("jobs").isNotNull(), F.concat(F.col("jobs").cast("string"), F.lit("-0"))),
    )
    return joined.withColumn("target", target).drop("items", "jobs")


def structure_view(nodes: DataFrame, chars: int = 500) -> DataFrame:
    """Nodes with their content cut for display."""
    return nodes.withColumn("shown", F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("..."))).otherwise(F.col("content")))


def table_view(cells: DataFrame, rows: int = 20) -> DataFrame:
    """Cells of the first rows of each table, and how many rows are left out."""
    n = F.max("row_idx").over(Window.partitionBy("doc_id", "table_id")) + 1
    return cells.withColumn("n_more", F.greatest(n - rows, F.lit(0))).where(F.col("row_idx") < rows)


def storage_estimate(docs: DataFrame, per_doc: int = 400, quota: int = 5 * 1024 * 1024) -> DataFrame:
    n = F.count("*")
    return docs.agg((n * per_doc).alias("n_bytes"), F.least(F.lit(100), js_round(n * per_doc / quota * 100)).cast("long").alias("percent"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Extension: fields of two documents side by side: same, changed, added or removed."""
    a = left.select(*keys, F.col(value).alias("before"), F.lit(True).alias("__a"))
    b = right.select(*keys, F.col(value).alias("after"), F.lit(True).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return a.join(b, keys, "full").withColumn("change", change).drop("__a", "__b")


