"""Registered queries over the synthetic tables and their SQL.

Each query applies one or a few operators to whole tables. The SQL says the same for DuckDB, whose
patterns have no look-around; queries without SQL are tested against hand-derived values instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.functions import classify, lang, pii, text
from papyrion.functions.rx import every, rx
from papyrion.operators import business, general, layout, letters, money, ocr, spreadsheet, store
from papyrion.plans import extraction, oracle, typed
from papyrion.plans.tables import spread, table
from papyrion.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(typed.QUERIES)
ORACLE_SQL: dict[str, str] = dict(typed.ORACLE_SQL)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("filename", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by detected type and language: how many, how long, and how many hold personal data."""
    found = extraction.classified(named(spark, sf_dir))
    return found.groupBy("detected_type", F.col("language.code").alias("language")).agg(
        F.count("*").alias("n_docs"), F.sum(text.count_words(F.col("text"))).alias("n_words"), F.sum(F.when(F.size("pii") > 0, 1).otherwise(0)).alias("n_with_pii")
    )


# --- text ------------------------------------------------------------------------------------------


@query(f"select doc_id, {oracle.WORDS} as n_words, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n_raw, greatest(1, floor({oracle.WORDS} / 220.0 + 0.5))::bigint as minutes from documents")
def text_word_stats(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", text.count_words(t).alias("n_words"), text.raw_word_count(t).alias("n_raw"), text.reading_minutes(text.count_words(t)).alias("minutes"))


@query(f"select doc_id, length(t)::bigint as n_chars, md5(t) as digest from (select doc_id, {oracle.WHITE_SPACE} as t from (select doc_id, regexp_replace(text, '([a-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g') as text from documents))")
def text_dehyphenate_ws(spark, sf_dir):
    t = text.normalize_whitespace(text.dehyphenate(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(oracle.PARAGRAPHS)
def text_paragraphs(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", text.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(oracle.READABILITY)
def text_readability(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.readability(F.col("text")).alias("r")).select("doc_id", "r.score", "r.grade")


@query(oracle.SPANS)
def span_clean(spark, sf_dir):
    spans = text.clean_spans(every(F.col("text"), r"\S+[.,;:!?)]+"))
    return documents(spark, sf_dir).select("doc_id", spans.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_spans"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query("select item_id, case when length(w) < 100 and position(w in text) > 0 then (case when greatest(position(w in text) - 40, 1) > 1 then '...' else '' end) || substring(text, greatest(position(w in text) - 40, 1), least(position(w in text) + length(w) + 40, length(text) + 1) - greatest(position(w in text) - 40, 1)) || (case when least(position(w in text) + length(w) + 40, length(text) + 1) <= length(text) then '...' else '' end) end as snippet from (select item_id, text, regexp_extract(text, '[a-z]+ [a-z]+\\.', 0) as w from benchmark) where w <> ''")
def provenance_snippets(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").withColumn("w", F.regexp_extract("text", r"[a-z]+ [a-z]+\.", 0)).where("w <> ''")
    return t.select("item_id", text.provenance(F.col("w"), F.col("text")).alias("snippet"))


@query("select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) as digest from pages")
def escape_pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("digest"))


# --- language --------------------------------------------------------------------------------------


@query(oracle.language("select doc_id, code, confidence from found"))
def lang_detect(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", lang.detect_language(F.col("text")).alias("l")).select("doc_id", "l.code", "l.confidence")


@query(oracle.language("select lang, code, count(*) as n from found group by all"))
def lang_confusion(spark, sf_dir):
    found = documents(spark, sf_dir, "lang").select("lang", lang.detect_language(F.col("text")).alias("l"))
    return found.groupBy("lang", F.col("l.code").alias("code")).agg(F.count("*").alias("n"))


# --- personal data ---------------------------------------------------------------------------------


def _pii_counts(t: Column) -> list[Column]:
    return [F.regexp_count(t, F.lit(rx(p, f))).cast("long").alias(f"n_{k}") for k, p, f, _ in pii.PATTERNS if k != "national_id"]


@query(oracle.pii_counts("documents", "doc_id"))
def pii_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *_pii_counts(F.col("text")))


@query(oracle.pii_counts("conversations", "conv_id, turn"))
def pii_counts_conversations(spark, sf_dir):
    return spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", *_pii_counts(F.col("text")))


@query(f"select quality, toxic, count(*) as n_docs, sum(n_email)::bigint as n_email, sum(n_phone)::bigint as n_phone from ({oracle.pii_counts('documents', 'doc_id')}) d left join labels using (doc_id) group by all")
def pii_by_label(spark, sf_dir):
    counts = documents(spark, sf_dir).select("doc_id", *_pii_counts(F.col("text")))
    joined = counts.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.sum("n_email").alias("n_email"), F.sum("n_phone").alias("n_phone"))


@query()
def pii_findings(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", pii.detect(F.col("text")).alias("pii"))
    return extraction.pii_rows(found)


@query()
def pii_redact(spark, sf_dir):
    found = documents(spark, sf_dir).withColumn("pii", pii.detect(F.col("text")))
    return found.select("doc_id", pii.summarize(F.col("pii")).alias("summary"), F.md5(pii.redact(F.col("text"), F.col("pii")).cast("binary")).alias("digest"), F.size(pii.redacted_pages(F.col("text"), F.col("pii"))).alias("n_pages"))


# --- classification --------------------------------------------------------------------------------


@query(oracle.classification("select doc_id, kind, confidence from verdict"))
def classify_docs(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", classify.classify(F.col("text"), F.lit("notes.txt")).alias("c"))
    return found.select("doc_id", F.col("c.type").alias("kind"), F.col("c.confidence").cast("long").alias("confidence"))


@query(oracle.classification("select kind, count(*) as n, min(doc_id) as first_seen from verdict group by kind order by n desc, first_seen limit 5"))
def classify_breakdown(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", classify.classify(F.col("text"), F.lit("notes.txt"))["type"].alias("kind"))
    return store.type_breakdown(found, order="doc_id", type_="kind")


@query(oracle.signals())
def classify_signals(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", classify.signals(F.col("text")).alias("s"))
    return found.select("doc_id", *[F.col(f"s.{n}").alias(n) for n in oracle.SIGNALS], F.size("s.headers").cast("long").alias("n_headers"))


@query(oracle.filenames())
def classify_filename(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "pages").select(F.col("url").alias("name")))
    found = names.select(classify.by_filename(F.col("name")).alias("c"))
    return found.groupBy(F.coalesce("c.type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


# --- entities and structure ------------------------------------------------------------------------


@query(oracle.ENTITIES)
def general_entities(spark, sf_dir):
    t = F.col("text")
    found = documents(spark, sf_dir).select("doc_id", general.dates_in(t).alias("d"), general.emails_in(t).alias("e"), general.urls_in(t).alias("u"), general.prices_in(t).alias("m"), letters.phones(t).alias("p"))
    size = lambda c, n: F.size(c).cast("long").alias(n)
    return found.select("doc_id", size("d", "n_dates"), size("e", "n_emails"), size("u", "n_urls"), size("m", "n_money"), size("p", "n_phones"), F.array_join(F.concat("d", "e", "u", "m", "p"), "|").alias("entities"))


@query()
def general_named_entities(spark, sf_dir):
    t = F.col("text")
    shown = documents(spark, sf_dir).withColumn("h", F.transform(general.text_outline(t), lambda h: h["heading"]))
    found = shown.select("doc_id", F.posexplode(general.named_entities(t, F.col("h"))).alias("pos", "e"))
    return found.select("doc_id", "pos", "e.*")


@query(oracle.OUTLINE)
def outline_markdown_caps(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", general.text_outline(F.col("text")).alias("o"))
    joined = F.array_join(F.transform("o", lambda h: F.concat_ws(":", h["level"].cast("string"), h["heading"])), "|")
    return found.select("doc_id", F.size("o").cast("long").alias("n_headings"), F.md5(joined.cast("binary")).alias("digest"))


@query()
def structure_nodes(spark, sf_dir):
    t = F.col("text")
    found = documents(spark, sf_dir).withColumn("o", general.text_outline(t)).select("doc_id", F.explode(general.structure_nodes(t, F.col("o"))).alias("n"))
    return store.structure_view(found.select("doc_id", "n.*"))


@query("select page_id, level, count(*) as n, md5(string_agg(heading, '|' order by heading)) as digest from (" + " union all ".join(f"select page_id, {k} as level, unnest(list_transform(regexp_extract_all(html, '(?i)<h{k}[^>]*>(.*?)</h{k}>', 1), lambda x: {oracle.trimmed(oracle.sub('x', '<[^>]*>'))})) as heading from pages" for k in range(1, 7)) + ") where heading <> '' group by all")
def html_headings(spark, sf_dir):
    found = spread(table(spark, sf_dir, "pages")).select("page_id", F.explode(files.html_headings(F.col("html"))).alias("h")).select("page_id", "h.*")
    return found.groupBy("page_id", "level").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("heading")), "|").cast("binary")).alias("digest"))


# --- tabular data ----------------------------------------------------------------------------------


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("o_orderpriority"))


@query(oracle.profile(oracle.ORDERS, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def csv_profile(spark, sf_dir):
    return spreadsheet.profile(spreadsheet.as_text(_orders(spark, sf_dir))).select(F.col("pos").cast("long").alias("pos"), "column", "type", "n_rows", "n_null")


@query("select count(*)::bigint as n_rows, (count(*) - (select count(*) from (select distinct event_type, user_id from events)))::bigint as n_duplicates from events")
def csv_duplicates(spark, sf_dir):
    return spreadsheet.duplicates(spreadsheet.as_text(table(spark, sf_dir, "events").select("event_type", "user_id")))


@query(f"select count(*)::bigint as n_rows, 5::bigint as n_columns, floor((5 * count(*) - count(*) filter (o_orderpriority is null)) / (5 * count(*)) * 100 * 10 + 0.5) / 10 as cell_completeness from ({oracle.ORDERS})")
def csv_completeness(spark, sf_dir):
    return spreadsheet.completeness(spreadsheet.profile(spreadsheet.as_text(_orders(spark, sf_dir))))


@query()
def csv_observations(spark, sf_dir):
    return spreadsheet.observations(spreadsheet.as_text(_orders(spark, sf_dir)))


# --- invoices and orders ---------------------------------------------------------------------------


def _cents(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


@query("select o_orderkey, sum(l_extendedprice::decimal(18,2))::double as items, o_totalprice::decimal(18,2)::double as stated, abs(sum(l_extendedprice::decimal(18,2)) - o_totalprice::decimal(18,2)) < 0.02 as matches, (o_totalprice::decimal(18,2) - sum(l_extendedprice::decimal(18,2)))::double as difference from lineitem join orders on l_orderkey = o_orderkey group by o_orderkey, o_totalprice")
def invoice_reconcile(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_cents("l_extendedprice")).alias("items"))
    joined = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("stated", _cents("o_totalprice"))
    gap = F.col("stated") - F.col("items")
    return joined.select("o_orderkey", F.col("items").cast("double").alias("items"), F.col("stated").cast("double").alias("stated"), (F.abs(gap) < 0.02).alias("matches"), gap.cast("double").alias("difference"))


def rendered(spark: SparkSession, sf_dir: str, head: str, number: str, party: str, totals: str) -> DataFrame:
    """Orders written out as documents, one line per item."""
    price = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    unit = (_cents("l_extendedprice") / F.col("l_quantity").cast("decimal(12,0)")).cast("decimal(18,2)")
    line = F.concat(F.lit("Goods of kind "), F.element_at(F.split(F.lit("alpha beta gamma delta"), " "), F.col("l_linenumber") % 4 + 1), F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), price(unit), F.lit(" "), price(_cents("l_extendedprice")))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_cents("l_extendedprice")).alias("s"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda r: r["x"]).alias("rows"))
    o = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    body = F.concat(
        F.lit(f"{head}\n{number}"), F.col("o_orderkey").cast("string"), F.lit("\nDate: "), day(0), F.lit("\nDue: "), day(30), F.lit(f"\n\n{party}: "), F.translate("c_name", "#", " "),
        F.lit("\n\nDescription Qty Unit Price Amount\n"), F.array_join("rows", "\n"), F.lit("\n\nSubtotal "), price(F.col("s")), F.lit(f"\n{totals} "), price(F.col("s")), F.lit("\n"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("scan.txt").alias("filename"), body.alias("text"))


_ROUND = "select o_orderkey as doc_id, '{0}' || o_orderkey as number, strftime(o_orderdate, '%Y-%m-%d') as day, count(*)::bigint as n_items, sum(l_extendedprice::decimal(18,2))::double as items, sum(l_extendedprice::decimal(18,2))::double as total, sum(l_quantity)::double as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by o_orderkey, o_orderdate"


def _round(found: DataFrame, number: str, day: str) -> DataFrame:
    d = found.select("doc_id", "details.*")
    items = F.floor(money.sum_totals(F.col("lineItems")) * 100 + 0.5) / 100
    quantity = F.aggregate("lineItems", F.lit(0.0), lambda a, x: a + x["quantity"])
    return d.select("doc_id", F.col(number).alias("number"), F.col(day).alias("day"), F.size("lineItems").cast("long").alias("n_items"), items.alias("items"), "total", quantity.alias("quantity"))


@query(_ROUND.format("INV-"))
def invoice_roundtrip(spark, sf_dir):
    return _round(business.invoice(rendered(spark, sf_dir, "Acme Supply LLC\n\nINVOICE", "Invoice No: INV-", "Bill To", "Total Due")), "invoiceNumber", "invoiceDate")


@query(_ROUND.format("PO-"))
def po_roundtrip(spark, sf_dir):
    return _round(business.purchase_order(rendered(spark, sf_dir, "PURCHASE ORDER", "PO Number: PO-", "Buyer", "Grand Total:")), "poNumber", "date")


@query("select o_orderkey, date_diff('day', o_orderdate::date, min(l_shipdate)::date)::bigint as days from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate")
def payment_terms(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("due"))
    joined = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    text_of = lambda c: money.with_date(money.normalize_date(F.date_format(c, "MM/dd/yyyy")))
    return joined.select("o_orderkey", F.datediff(text_of("due"), text_of("o_orderdate")).cast("long").alias("days"))


@query("select raw, try_cast(replace(replace(raw, '$', ''), ',', '') as double) as value, '$' || format('{:,.2f}', value) as shown, 'USD' as currency from (select '$' || format('{:,.2f}', p_retailprice) as raw from part)")
def money_parse_format(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("raw"))
    v = raw.withColumns({"value": money.parse_money(F.col("raw")), "currency": money.detect_currency(F.col("raw"))})
    return v.withColumn("shown", money.format_money(F.col("value"), F.col("currency"))).select("raw", "value", "shown", "currency")


# --- letters ---------------------------------------------------------------------------------------


@query(oracle.REQUESTS)
def conversation_requests(spark, sf_dir):
    found = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", letters.requests(F.col("text")).alias("r"))
    return found.select("conv_id", "turn", F.size("r").cast("long").alias("n_requests"), F.md5(F.array_join("r", "|").cast("binary")).alias("digest"))


@query(oracle.letter_types())
def letter_types(spark, sf_dir):
    found = spread(table(spark, sf_dir, "conversations")).select(letters.letter_type(F.col("text"), F.lit("x.txt")).alias("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


# --- history and views -----------------------------------------------------------------------------


@query("select user_id, ts as since, nxt as until, epoch_us(nxt) - epoch_us(ts) as micros from (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) where epoch_us(nxt) - epoch_us(ts) > 86400000000")
def activity_gaps(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("until", F.lead("ts").over(own))
    micros = F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("user_id", F.col("ts").alias("since"), "until", micros.alias("micros")).where("micros > 86400000000")


def _history(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("-", "source", "lang").alias("id"), F.col("doc_id").alias("seq"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), F.col("lang").alias("detected_type"), (F.col("n_chars") % 101).alias("completeness"))


@query("select id, seq, filename, detected_type, completeness from (select source || '-' || lang as id, doc_id as seq, 'doc-' || doc_id as filename, lang as detected_type, n_chars % 101 as completeness, row_number() over (partition by source, lang order by doc_id desc) as k from documents) where k = 1 order by seq desc limit 20")
def history_top20(spark, sf_dir):
    h = _history(spark, sf_dir)
    half = F.col("seq") % 2 == 0
    return store.upsert(h.where(half), h.where(~half))


@query("select source || '-' || lang as detected_type, count(*) as n, min(doc_id) as first_seen from documents group by 1 order by n desc, first_seen limit 5")
def type_top5(spark, sf_dir):
    return store.type_breakdown(_history(spark, sf_dir).withColumn("detected_type", F.col("id")))


@query("select count(*) as n_docs, least(5, count(distinct lang))::bigint as n_types, floor(sum(n_chars % 101) / count(*) + 0.5)::bigint as avg_completeness, (select lang from documents group by lang order by count(*) desc, min(doc_id) limit 1) as most_common from documents")
def dashboard_kpis(spark, sf_dir):
    return store.kpis(_history(spark, sf_dir))


@query("select doc_id as seq, substring('doc-' || doc_id, 1, 12) as name, n_chars % 101 as score from documents order by doc_id desc limit 10")
def trend10(spark, sf_dir):
    return store.trend(_history(spark, sf_dir))


@query("select count(*) as n, case when lower('doc-' || doc_id) like '%7%' then 1 else 0 end as hit from documents where lang = 'en' and 'doc-' || doc_id like '%7%' group by 2")
def dashboard_search(spark, sf_dir):
    return store.search(_history(spark, sf_dir), "7", "en").groupBy(F.lit(1).alias("hit")).agg(F.count("*").alias("n"))


@query("select bucket, count(*) as n from (select case when h < 24 then 'Today' when h < 168 then 'Earlier this week' else 'Older' end as bucket from (select (epoch((select max(ts) from events)) - epoch(ts)) / 3600 as h from events)) group by bucket")
def age_buckets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    last = e.agg(F.max("at").alias("last"))  # one row
    hours = (F.col("last") - F.col("at")) / 3.6e9
    return e.crossJoin(F.broadcast(last)).groupBy(store.age_bucket(hours).alias("bucket")).agg(F.count("*").alias("n"))


@query("select user_id, event_id, ts, case when h < 24 then 'Today' when h < 168 then 'Earlier this week' else 'Older' end as bucket from (select *, (epoch(timestamp '2030-01-01') - epoch(ts)) / 3600 as h, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1 order by event_id desc limit 8")
def recent8(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("at", F.col("ts").cast("timestamp"))
    return store.recent(e, F.lit("2030-01-01 00:00:00").cast("timestamp"), key="user_id", order="event_id", at="at").select("user_id", "event_id", "ts", "bucket")


def _fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value"), F.lit("high").alias("confidence")), F.struct(F.lit("source").alias("key"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("value"), F.lit("low").alias("confidence")))
    return d.select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


@query("select d.doc_id, 'lang' as key, case when quality = 0 then 'review' else lang end as value, coalesce(quality = 0, false) as edited from documents d left join labels l using (doc_id) union all select doc_id, 'source', case when doc_id % 5 > 0 then source end, false from documents")
def corrections_applied(spark, sf_dir):
    log = table(spark, sf_dir, "labels").select("doc_id", F.lit("lang").alias("field_key"), F.when(F.col("quality") == 0, "review").alias("value"), F.lit(1).alias("corrected_at"))
    fields = _fields(spark, sf_dir).drop("confidence")
    return store.apply_corrections(fields, store.effective_corrections(fields, store.current_corrections(log))).select("doc_id", "key", "value", "edited")


@query("select doc_id, 2::bigint as n_fields, (1 + (doc_id % 5 > 0)::int)::bigint as n_filled, (doc_id % 5 > 0)::int::bigint as n_low from documents")
def coverage(spark, sf_dir):
    return store.coverage(_fields(spark, sf_dir))


@query("select doc_id, coalesce(n, 0)::bigint as n_notes, md5(coalesce(t, '')) as digest from documents left join (select conv_id, count(*) as n, string_agg(text, '|' order by turn) as t from conversations group by conv_id) on conv_id = doc_id")
def annotations_joined(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    found = store.annotations_of(docs, notes, ["doc_id"])
    return found.select("doc_id", F.size("notes").cast("long").alias("n_notes"), F.md5(F.array_join("notes", "|").cast("binary")).alias("digest"))


@query("select p_partkey, p_name, p_brand from part where lower(p_name) like '%an%' or lower(p_brand) like '%an%' or lower(p_type) like '%an%'")
def row_search(spark, sf_dir):
    return store.row_search(table(spark, sf_dir, "part"), "AN", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query("select 'p_size' as column, count(*)::bigint as n_numeric from part union all select 'p_retailprice', count(*) from part")
def numeric_columns(spark, sf_dir):
    return store.numeric_columns(table(spark, sf_dir, "part"), {"p_name": "text", "p_brand": "currency", "p_size": "number", "p_retailprice": "currency"})


@query("select p_partkey, p_name as name, p_retailprice as value from part order by p_partkey limit 50")
def chart_series(spark, sf_dir):
    return store.chart_series(table(spark, sf_dir, "part"), {"p_name": "text", "p_retailprice": "currency"}, "p_retailprice", "p_partkey")


@query("select c_custkey, c_mktsegment, c_acctbal from customer order by c_acctbal desc, c_custkey")
def sorted_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return store.sort_rows(c, [("c_acctbal", "currency", True), ("c_custkey", "number", False)]).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("select count(*) * 400 as n_bytes, least(100, floor(count(*) * 400 / (5 * 1024 * 1024.0) * 100 + 0.5))::bigint as percent from documents")
def storage_estimate(spark, sf_dir):
    return store.storage_estimate(table(spark, sf_dir, "documents"))


@query("select filename, type, confidence, completeness, ocrUsed, extractedAt from (select 'doc-' || doc_id as filename, lang as type, 50 as confidence, n_chars % 101 as completeness, false as ocrUsed, '2024-01-01' as extractedAt from documents)")
def history_export(spark, sf_dir):
    h = _history(spark, sf_dir).withColumns({"classification_confidence": F.lit(50), "ocr_used": F.lit(False), "extracted_at": F.lit("2024-01-01")})
    return sinks.history_export(h)


@query("select '\"' || p_partkey || '\",\"' || replace(p_name, '\"', '\"\"') || '\",\"' || p_retailprice || '\"' as line from part")
def table_csv(spark, sf_dir):
    return table(spark, sf_dir, "part").select(sinks.csv_line([F.col("p_partkey"), F.col("p_name"), F.col("p_retailprice")]).alias("line"))


# --- layout, recognition, files --------------------------------------------------------------------


@query(oracle.LAYOUT)
def layout_text(spark, sf_dir):
    """Texts laid out as words on pages of forty lines, and read back."""
    rows = documents(spark, sf_dir).select("doc_id", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S")).alias("l"))
    rows = rows.select("doc_id", F.posexplode("l").alias("n", "line"))
    words = rows.select("doc_id", "n", F.posexplode(F.filter(F.split("line", r"\s+"), lambda w: w != "")).alias("k", "str"))
    place = {"page": F.floor(F.col("n") / 40).cast("int") + 1, "seq": F.col("n") * 100000 + F.col("k"), "x": (F.lit(72.0) + F.col("k") * 40), "y": 700.0 - (F.col("n") % 40) * 14, "width": F.lit(30.0), "height": F.lit(12.0), "font_size": F.lit(12.0), "page_width": F.lit(612.0)}
    found = layout.layout(words.withColumns(place))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"), F.size("headings").cast("long").alias("n_headings"), "body_size")


@query(oracle.ocr_query())
def ocr_noise(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lines = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "text", ((F.col("conv_id") * 7 + F.col("turn") * 17) % 101).cast("double").alias("confidence"))
    found = ocr.analyze(lines)
    digits = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return found.select("doc_id", "n_lines", "n_noise", F.md5(F.col("high_text").cast("binary")).alias("high"), F.md5(F.col("low_text").cast("binary")).alias("low"), digits("high_ratio"), digits("mean_confidence"))


@query("select doc_id, case when strlen(text) = 0 then 'empty' when strlen(text) < 10 then 'too small' end as error, 'text/plain' as mime, 'text' as parser from documents")
def file_guards(spark, sf_dir):
    raw = documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    mime = files.sniff(F.col("content"), F.lit("text/plain"))
    return raw.select("doc_id", files.size_error(F.octet_length("content")).alias("error"), mime.alias("mime"), files.parser_of(mime, F.lit("a.txt")).alias("parser"))


# --- whole results ---------------------------------------------------------------------------------


@query()
def extraction_results(spark, sf_dir):
    """Every document through the whole plan: type, score and counts of what was found."""
    found = extraction.results(named(spark, sf_dir))
    return found.select("doc_id", "detected_type", "classification_confidence", F.col("language.code").alias("language"), "completeness", F.size("fields").alias("n_fields"), F.size("tables").alias("n_tables"), F.size("insights").alias("n_insights"), F.size("pii").alias("n_pii"), F.md5(F.col("details").cast("binary")).alias("details"))


@query()
def insight_severities(spark, sf_dir):
    found = extraction.results(named(spark, sf_dir), types=["general"])
    return store.severity_counts(extraction.insight_rows(found))


@query()
def text_reports(spark, sf_dir):
    return sinks.text_report(extraction.results(named(spark, sf_dir), types=["general"])).select("doc_id", F.length("report").alias("n_chars"), F.md5(F.col("report").cast("binary")).alias("digest"))


@query()
def html_reports(spark, sf_dir):
    return sinks.html_report(extraction.results(named(spark, sf_dir), types=["general"])).select("doc_id", F.length("report").alias("n_chars"), F.md5(F.col("report").cast("binary")).alias("digest"))


