"""Layout, files, reports, store operations and streaming."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from papyrion.operators import generated, layout, spreadsheet, store
from papyrion.plans import extraction
from papyrion.sources import files, sinks
from papyrion.streaming import ingest


ITEMS = "doc_id long, page int, seq int, str string, x double, y double, width double, height double, font_size double, page_width double"


def item(text, x=72.0, y=700.0, size=12.0, page=1, width=50.0):
    return (page, text, float(x), float(y), float(width), float(size), float(size))


def laid(spark, items):
    rows = [(1, p, k, t, x, y, w, h, s, 612.0) for k, (p, t, x, y, w, h, s) in enumerate(items)]
    return layout.layout(spark.createDataFrame(rows, ITEMS)).first()


def test_columns(spark):
    two = [item(f"l{k}", 50, 700 - 20 * k) for k in range(3)] + [item(f"r{k}", 350, 700 - 20 * k) for k in range(3)]
    assert [(c.column, c.n_items) for c in laid(spark, two).columns] == [(0, 3), (1, 3)]
    edge = [*two, item("edge", 201, 500)]  # the boundary lies at 200
    assert [(c.x_min, c.x_max, c.n_items) for c in laid(spark, edge).columns] == [(50, 251, 4), (201, 400, 4)]
    assert len(laid(spark, [item("a"), item("b", 73)]).columns) == 1
    blank = laid(spark, [item(" "), item("b", page=2)])
    assert blank.text == "\n\nb" and [c.page for c in blank.columns] == [2] and blank.body_size == 12
    outside = [item(t, x, 700 - 20 * k) for k in range(2) for t, x in (("a", 700), ("b", 1000))]
    assert [(c.column, c.n_items) for c in laid(spark, outside).columns] == [(0, 4)]


def test_headings_and_levels(spark):
    plain = [item("body", y=300 - 20 * k) for k in range(6)]
    found = laid(spark, [item("Title", size=24), item("42", y=600, size=24), *plain, item("Sub", y=400, size=18), item("Sub two", x=200, y=400, size=19)])
    assert [(h.text, h.level) for h in found.headings] == [("Title", 1), ("Sub two", 2)]
    # 24 is near 28 and joins it, yet takes the level of the nearest size that has one
    sizes = [28.0, 24.0, 22.0, 18.0]
    found = laid(spark, [*plain, *[item(f"Head {s}", y=700 - 30 * k, size=s) for k, s in enumerate(sizes)], *[item("body", y=300 - 20 * k, page=2) for k in range(3)]])
    assert [h.level for h in found.headings] == [1, 2, 2, 3]
    many = spark.range(1).select(layout.levels_of(F.array(*map(F.lit, [60.0, 45.0, 35.0, 28.0, 20.0, 19.0]))).alias("l")).first().l
    assert [(e.size, e.level) for e in many] == [(60, 1), (45, 3), (35, 4), (28, 4), (20, 4), (19, 4)]


def test_tables(spark):
    rows = [("Term", "Meaning"), ("ab", "first"), ("cd", "second")]
    items = [item(t, x, 700 - 20 * k) for k, r in enumerate(rows) for t, x in zip(r, (100.0, 300.0))]
    got = laid(spark, [*items, item("x", 10, 100), *[item(t, x + 1, y, page=2) for t, x, y in (("y" * 41, 50, 500), ("z", 200, 501), ("more", 50, 480), ("v", 200, 479), ("w", 205, 479))]])
    assert [(t.id, t.columns, t.rows, t.page, t.y_start) for t in got.tables] == [
        ("layout-table-0", ["Term", "Meaning"], [["ab", "first"], ["cd", "second"]], 1, 700),
        ("layout-table-1", ["Column 1", "Column 2"], [["y" * 41, "z"], ["more", "v w"]], 2, 500),
    ]
    assert laid(spark, items[:3]).tables == []


def test_lines_and_merge(spark):
    assert laid(spark, [item("b", y=690), item("a"), item("c", y=701)]).text == "c a\nb"
    two = [item("l", 50, 700), item("l2", 50, 640), item("r", 350, 700), item("r2", 350, 640)]
    assert laid(spark, two).text == "l  r\nl2  r2"
    assert laid(spark, [*two, item("m", 52, 697)]).text == "l m  r\nl m  r\nl2  r2"


def test_layout_of_documents(spark):
    cols = "doc_id long, page int, seq int, str string, x double, y double, width double, height double, font_size double, page_width double"
    rows = [(d, 1, k, t, 72.0, 700.0 - 30 * k, 50.0, 12.0, s, 612.0) for d in (1, 2) for k, (t, s) in enumerate([("Big title", 24.0), ("some text here", 12.0), (" ", 12.0), ("more text", 12.0)])]
    found = layout.layout(spark.createDataFrame(rows, cols))
    r = {x.doc_id: x for x in found.collect()}
    assert r[1].text == "Big title\nsome text here\nmore text" and r[1].body_size == 12.0
    assert [(h.doc_id, h.text, h.level) for h in layout.heading_rows(found).orderBy("doc_id").collect()] == [(1, "Big title", 1), (2, "Big title", 1)]
    assert layout.column_rows(found).count() == 2 and layout.table_rows(found).count() == 0
    assert layout.layout(spark.createDataFrame([], cols)).count() == 0
    sizes = spark.createDataFrame([(-14.04,), (0.0,)], "s double").select(layout.font_size(F.col("s"))).collect()
    assert [x[0] for x in sizes] == [14.0, 12.0]


def test_ocr_page_choice(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 81), (1, 2, ""), (2, 1, "short")], "doc_id long, page int, text string")
    assert {r.doc_id: r.needs_ocr for r in layout.needs_ocr(pages).collect()} == {1: False, 2: True}
    ops = spark.createDataFrame([(1, p, n) for p, n in [(1, 0), (2, 5), (3, 1), (4, 5), (7, 99)]], "doc_id long, page int, n_images int")
    assert sorted(r.page for r in layout.image_pages(ops).collect()) == [2, 4]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for t, s in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    made = {
        "a.txt": b"Plain words in a file of text",
        "b.csv": b'name,n\nAda,1\n"B, b",2\n',
        "c.docx": docx([("My Head", "Heading1"), ("Body words", None)]),
        "d.xlsx": sinks.xlsx_bytes("Sheet & one", ["a", "b"], [["1", 'x"y'], [None, "z"]]),
        "e.pdf": b"%PDF-1.7 rest of it",
        "f.bin": b"0123456789abc",
        "h.txt": b"tiny",
        "i.docx": b"PK\x03\x04 broken archive",
    }
    for n, b in made.items():
        (tmp_path / n).write_bytes(b)
    read = files.read(spark, str(tmp_path)).withColumn("doc_id", F.crc32(F.col("filename").cast("binary")))
    got = {r.filename: r for r in files.parse(read).collect()}
    assert got["a.txt"].text == "Plain words in a file of text" and got["b.csv"].tabular
    assert got["c.docx"].text == "My Head\n\nBody words" and [tuple(h) for h in got["c.docx"].headings] == [("My Head", 1)]
    assert got["d.xlsx"].text.startswith("--- Sheet: Sheet & one ---\n\na,b\n\n1,")
    assert (got["e.pdf"].error, got["h.txt"].error) == ("needs decoded items", "too small")
    sizes = spark.createDataFrame([(0,), (9,), (10,), (files.MAX_BYTES + 1,)], "n long").select(files.size_error(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["empty", "too small", None, "too large"]
    assert got["f.bin"].error.startswith("unsupported") and got["i.docx"].error.startswith("docx parsing failed")
    assert {r.status: r.n for r in extraction.batch_status(files.parse(read)).collect()} == {"done": 4, "error": 4}
    table = files.read_table(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in table.collect()] == [("Ada", "1"), ("B, b", "2")]


@pytest.mark.parametrize("head, mime", [(b"%PDF-", "application/pdf"), (b"\x89PNG....", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"RIFF1234WEBP", "image/webp"), (b"RIFF1234WAVE", "x"), (b"PK\x05\x06", "application/zip"), (b"GIF89a", "image/gif"), (b"", "x")])
def test_sniff(spark, head, mime):
    assert spark.createDataFrame([(bytearray(head),)], "b binary").select(files.sniff(F.col("b"), F.lit("x"))).first()[0] == mime


def test_html_headings(spark):
    page = "<H2 class=x>One <b>two</b></H2><h1></h1><h3>x</h4></h3>"
    got = spark.createDataFrame([(page,)], "p string").select(files.html_headings(F.col("p"))).first()[0]
    assert [tuple(h) for h in got] == [("One two", 2), ("x", 3)]


def test_reports(spark, tmp_path):
    from samples import INVOICE

    found = extraction.results(spark.createDataFrame([(1, "invoice.txt", INVOICE)], "doc_id long, filename string, text string"), normalize=False, types=["invoice"])
    fixed = found.withColumns({"corrections": F.create_map(F.lit("vendorName"), F.lit("Southwind")), "notes": F.array(F.lit("check it"))})
    text = sinks.text_report(fixed).first().report
    assert "Name: Southwind [MEDIUM] [EDITED]" in text and "TABLE: Line Items" in text and "Steel brackets" in text and "- check it" in text and "(2 rows x 4 columns)" in text
    page = sinks.html_report(found).first().report
    assert page.startswith("<!DOCTYPE html>") and "<td>Acme Rockets</td>" in page and 'class="high"' in page
    assert json.loads(sinks.to_json(found).first().json)["detected_type"] == "invoice"
    book = sinks.to_xlsx(found).first()
    assert files.xlsx_text(bytes(book.content)).split("\n")[1:3] == ["Description,Qty,Unit Price,Total", "Steel brackets,4.0,25.0,100.0"]
    rows = spark.createDataFrame([('a "q"', None)], "x string, y string")
    sinks.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[1].value == '"a ""q""",""'
    line = spark.createDataFrame([('a "q"', None)], "x string, y string").select(sinks.csv_line([F.col("x"), F.col("y")])).first()[0]
    assert line == '"a ""q""",""'


HIST = "id string, seq long, filename string, detected_type string, completeness int"


def history(spark, n=25):
    return spark.createDataFrame([(f"d{i}", i, f"file {i}", ["invoice", "general", "resume"][i % 3], i) for i in range(n)], HIST)


def test_history(spark):
    old = history(spark)
    assert [r.id for r in store.upsert(old.limit(0), old).collect()][:2] == ["d24", "d23"] and store.upsert(old.limit(0), old).count() == 20
    again = spark.createDataFrame([("d3", 99, "new name", "general", 1)], HIST)
    top = store.upsert(old, again).collect()
    assert (top[0].id, top[0].filename) == ("d3", "new name") and [r.id for r in top].count("d3") == 1
    assert store.remove(old, again).count() == 24 and store.lookup(old, "d7").first().seq == 7 and store.lookup(old, "zz").count() == 0


def test_rehydrate(spark):
    raw = [(0, '{"id":"a","filename":"f","completenessScore":7}'), (1, '{"id":"a","filename":"later"}'), (2, '{"filename":"none"}'), (3, "broken"), (4, '{"id":"b","ocrUsed":true}')]
    got = {r.id: r for r in store.rehydrate(spark.createDataFrame(raw, "seq long, json string"), "now").collect()}
    assert set(got) == {"a", "b"} and got["a"].filename == "f" and got["a"].detectedType == "general" and got["b"].ocrUsed and got["b"].extractedAt == "now"


def test_corrections_and_notes(spark):
    fields = spark.createDataFrame([("1", "a", "old"), ("1", "b", None), ("2", "a", "x")], "doc_id string, key string, value string")
    log = spark.createDataFrame([("1", "a", "v1", 1), ("1", "a", "v2", 2), ("2", "a", "x", 1), ("1", "b", "gone", 1), ("1", "b", None, 2)], "doc_id string, field_key string, value string, corrected_at long")
    current = store.current_corrections(log)
    assert {(r.doc_id, r.field_key): r.value for r in current.collect()} == {("1", "a"): "v2", ("2", "a"): "x"}
    real = store.effective_corrections(fields, current)
    assert [(r.doc_id, r.value) for r in real.collect()] == [("1", "v2")]
    assert {(r.doc_id, r.key): (r.value, r.edited) for r in store.apply_corrections(fields, real).collect()} == {("1", "a"): ("v2", True), ("1", "b"): (None, False), ("2", "a"): ("x", False)}
    notes = spark.createDataFrame([("1", "n2", "two", 2), ("1", "n1", "one", 1)], "doc_id string, id string, text string, created_at long")
    docs = spark.createDataFrame([("1",), ("2",)], "doc_id string")
    assert {r.doc_id: r.notes for r in store.annotations_of(docs, notes, ["doc_id"]).collect()} == {"1": ["one", "two"], "2": []}


def test_dashboard(spark):
    h = history(spark, 10)
    assert [(r.detected_type, r.n) for r in store.type_breakdown(h).collect()] == [("invoice", 4), ("general", 3), ("resume", 3)]
    k = store.kpis(h).first()
    assert (k.n_docs, k.n_types, k.avg_completeness, k.most_common) == (10, 3, 5, "invoice")
    assert [r.seq for r in store.trend(history(spark, 12)).collect()] == list(range(2, 12)) and store.trend(history(spark, 1)).count() == 0
    assert store.search(h, "RESUME").count() == 3 and store.search(h, "file 1", "general").count() == 1 and store.search(h).count() == 10
    aged = h.withColumn("extracted_at", F.timestamp_seconds(F.lit(1_000_000) - F.col("seq") * 40_000))
    got = store.recent(aged, F.timestamp_seconds(F.lit(1_000_000))).collect()
    assert [r.bucket for r in got] == ["Earlier this week"] * 7 + ["Today"] or len(got) == 8
    assert store.storage_estimate(h).first().n_bytes == 4000


def test_tables_and_insights(spark):
    rows = spark.createDataFrame([("Ada", "1.5", None), ("bob", "x", "2"), ("Cy", "", "ADA")], "name string, n string, m string")
    assert store.row_search(rows, "ada").count() == 2 and store.row_search(rows, " ").count() == 3
    assert [tuple(r) for r in store.numeric_columns(rows, {"name": "text", "n": "number", "m": "number"}).collect()] == [("n", 2)]
    assert [r.name for r in store.sort_rows(rows, [("n", "number", True)]).collect()][0] == "Ada"
    assert store.chart_series(rows.where("n = '1.5'"), {"name": "text", "n": "number"}, "n", "name").first().value == 1.5
    own = spark.createDataFrame([(1, 0, "a", "x", "totals do not reconcile", "info"), (1, 1, "b", "y", "an employment gap", "warning")], "doc_id long, pos int, id string, category string, body string, severity string")
    made = spark.createDataFrame([(1, 0, "c", "x", "other", "info")], "doc_id long, pos int, id string, category string, body string, severity string")
    both = store.all_insights(own, made)
    assert {(r.category, r.n) for r in store.insights_by_category(both).collect()} == {("x", 2), ("y", 1)}
    assert tuple(store.severity_counts(both).first()) == (1, 2, 0, 1)
    tabs = spark.createDataFrame([(1, 0, "experience", "Experience", 3), (1, 1, "lineItems", "Line Items", 4)], "doc_id long, table_idx int, id string, title string, n_rows int")
    assert {r.id: r.target for r in store.insight_targets(own, tabs).collect()} == {"a": "1-3", "b": "0-0"}
    left = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    right = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")
    assert {r.key: r.change for r in store.compare(left, right, ["key"]).collect()} == {"a": "removed", "b": "changed", "c": "added"}


def test_coverage(spark):
    rows = spark.createDataFrame([(1, "L", "v", "low"), (1, "M", None, "low"), (1, "N", "w", "high")], "doc_id long, label string, value string, confidence string")
    assert tuple(store.coverage(rows).first()) == (1, 3, 2, 1) and store.field_filter(rows, "W").count() == 1


def test_profiles(spark):
    rows = spark.createDataFrame([("$1.00", "1", "2024-01-02", "a@b.c", "http://x", None, "x"), ("2.50", "-2.5", "1/2/24", "d@e.f", "https://y", "", "1"), ("2.50", "-2.5", "1/2/24", "d@e.f", "https://y", "", "1")], "a string, b string, c string, d string, e string, f string, g string")
    text = spreadsheet.as_text(rows)
    assert [(r.column, r.type, r.n_null) for r in spreadsheet.profile(text).orderBy("pos").collect()] == [("a", "currency", 0), ("b", "number", 0), ("c", "date", 0), ("d", "email", 0), ("e", "url", 0), ("f", "text", 3), ("g", "text", 0)]
    assert tuple(spreadsheet.duplicates(text).first()) == (3, 1)
    assert spreadsheet.completeness(spreadsheet.profile(text)).first().cell_completeness == 85.7
    assert [r.id for r in spreadsheet.observations(text).orderBy("place", "pos").collect()] == ["duplicate-rows", "empty-col-f", "summary"]
    empty = spreadsheet.observations(text.limit(0)).orderBy("place", "pos").collect()
    assert [r.id for r in empty] == ["high-null-rate"] + [f"empty-col-{c}" for c in "abcdefg"]


def test_generated(spark):
    raw = [(1, '{"insights":[{"title":"T","body":"B","severity":"bad"}]}'), (2, 'Sure: {"insights":[{"title":"x","category":"C","severity":"warning"}]} done'), (3, "no json"), (4, '{"other":1}'), (5, None)]
    got = {r.doc_id: (r.v, r.s) for r in spark.createDataFrame(raw, "doc_id long, raw string").select("doc_id", generated.validate(F.col("raw")).alias("v"), generated.status(F.col("raw")).alias("s")).collect()}
    assert tuple(got[1][0][0]) == ("T", "B", "AI Insight", "info") and tuple(got[2][0][0]) == ("x", "", "C", "warning")
    assert [got[i][1] for i in range(1, 6)] == ["ready", "ready", "error", "error", "error"]
    asked = generated.request(spark.createDataFrame([(1, "secret", 5)], "doc_id long, text string, score int"))
    assert json.loads(asked.first().payload) == {"doc_id": 1, "score": 5}
    assert generated.ask(asked, None).first().error == "no provider configured"

    def fail(payload):
        raise RuntimeError("down")

    assert generated.ask(asked, lambda p: '{"insights":[]}').first().raw == '{"insights":[]}' and generated.ask(asked, fail).first().error == "RuntimeError: down"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"doc_id":1,"filename":"invoice.txt","text":"x","seq":1}\n{"doc_id":2,"filename":"n.txt","text":"hi jo@x.org","seq":2}\n')
    for extra in ('{"doc_id":1,"filename":"cv.txt","text":"y","seq":3}\n',):
        ingest.to_history(ingest.documents(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        (src / "b.json").write_text(extra)
    ingest.to_history(ingest.documents(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.doc_id: r for r in ingest.history(spark, str(tmp_path / "out")).collect()}
    assert got[1].detected_type == "resume" and [p.type for p in got[2].pii] == ["email"]
