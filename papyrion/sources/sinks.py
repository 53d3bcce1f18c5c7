"""Writing results: JSON, text and HTML reports, delimited and spreadsheet tables, history and state."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.classify import label
from papyrion.functions.text import escape_html

RULE, THIN = "═" * 60, "─" * 60


def to_json(results: DataFrame, pretty: bool = False) -> DataFrame:
    """``doc_id, json`` with the whole result."""
    return results.select("doc_id", F.to_json(F.struct(*results.columns), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def _field_lines(fields: Column, corrections: Column) -> Column:
    groups = F.array_distinct(F.transform(fields, lambda f: f["group"]))

    def one(f: Column) -> Column:
        new = F.try_element_at(corrections, f["key"])
        value = F.coalesce(new, f["value"], F.lit("—"))
        return F.concat(F.lit("  │  "), f["label"], F.lit(": "), value, F.lit(" ["), F.upper(f["confidence"]), F.lit("]"), F.when(new.isNotNull(), " [EDITED]").otherwise(""))

    def group(g: Column) -> Column:
        own = F.filter(fields, lambda f: f["group"] == g)
        found = F.size(F.filter(own, lambda f: f["value"].isNotNull()))
        tail = F.concat(F.lit("  └── ("), found.cast("string"), F.lit("/"), F.size(own).cast("string"), F.lit(" found)"))
        return F.concat(F.array(F.concat(F.lit("  ┌─ "), g), F.lit("  │")), F.transform(own, one), F.array(tail, F.lit("")))

    return F.flatten(F.transform(groups, group))


def _table_lines(tables: Column) -> Column:
    def one(t: Column) -> Column:
        def width(c: Column) -> Column:
            longest = F.array_max(F.transform(t["rows"], lambda r: F.coalesce(F.length(F.try_element_at(r, c["id"])), F.lit(2))))
            return F.least(F.greatest(F.length(c["label"]), F.coalesce(longest, F.lit(0)), F.lit(4)), F.lit(40))

        cols = F.transform(t["columns"], lambda c: F.struct(c["id"].alias("id"), c["label"].alias("label"), width(c).alias("w")))
        cell = lambda s, w: F.when(F.length(s) > w, F.concat(F.substring(s, F.lit(1), w - 1), F.lit("..."))).otherwise(F.rpad(s, w, F.lit(" ")))
        line = lambda r: F.concat(F.lit("  "), F.array_join(F.transform(cols, lambda c: cell(F.coalesce(F.try_element_at(r, c["id"]), F.lit("—")), c["w"])), " | "))
        head = F.concat(F.lit("  "), F.array_join(F.transform(cols, lambda c: F.rpad(c["label"], c["w"], F.lit(" "))), " | "))
        rule = F.concat(F.lit("  "), F.array_join(F.transform(cols, lambda c: F.repeat(F.lit("─"), c["w"])), "-+-"))
        count = F.concat(F.lit("  ("), F.size(t["rows"]).cast("string"), F.lit(" rows x "), F.size(t["columns"]).cast("string"), F.lit(" columns)"))
        return F.concat(F.array(F.lit(RULE), F.concat(F.lit("  TABLE: "), t["title"]), F.lit(THIN), F.lit(""), head, rule), F.transform(t["rows"], line), F.array(F.lit(""), count, F.lit("")))

    return F.flatten(F.transform(tables, one))


def text_report(results: DataFrame) -> DataFrame:
    """``doc_id, report``: a plain text report.

    ``results`` may hold ``corrections`` (map of field key to value) and ``notes`` (array of texts).
    """
    c = F.col
    fixes = c("corrections") if "corrections" in results.columns else F.create_map().cast("map<string,string>")
    notes = c("notes") if "notes" in results.columns else F.array().cast("array<string>")
    line = lambda name, value: F.concat(F.lit(f"  {name}:".ljust(14)), value)
    head = F.array(
        F.lit(RULE), F.lit("  EXTRACTION REPORT"), F.lit(RULE), F.lit(""), line("Document", c("filename")), line("Type", label(c("detected_type"))),
        line("Score", F.concat(c("completeness").cast("string"), F.lit("/100"))), F.lit(""), F.lit(RULE), F.lit(""),
    )
    seen = F.transform("insights", lambda i: F.concat(F.lit("  ["), F.upper(i["severity"]), F.lit("] "), i["title"], F.lit("\n    "), i["body"], F.lit("\n  Category: "), i["category"], F.lit("\n")))
    said = F.when(F.size("insights") > 0, F.concat(F.array(F.lit(RULE), F.concat(F.lit("  INSIGHTS ("), F.size("insights").cast("string"), F.lit(")")), F.lit(RULE), F.lit("")), seen)).otherwise(F.array().cast("array<string>"))
    noted = F.when(F.size(notes) > 0, F.concat(F.array(F.lit(RULE), F.concat(F.lit("  DOCUMENT NOTES ("), F.size(notes).cast("string"), F.lit(")")), F.lit(RULE)), F.transform(notes, lambda n: F.concat(F.lit("  - "), n)))).otherwise(F.array().cast("array<string>"))
    return results.select("doc_id", F.array_join(F.concat(head, _field_lines(c("fields"), fixes), _table_lines(c("tables")), said, noted, F.array(F.lit(RULE))), "\n").alias("report"))


def score_class(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def html_report(results: DataFrame) -> DataFrame:
    """``doc_id, report``: an HTML report with all texts escaped."""
    c, e = F.col, escape_html
    field = lambda f: F.concat(F.lit("<tr><th>"), e(f["label"]), F.lit("</th><td>"), e(F.coalesce(f["value"], F.lit("—"))), F.lit("</td><td>"), f["confidence"], F.lit("</td></tr>"))
    cells = lambda t, r: F.array_join(F.transform(t["columns"], lambda k: F.concat(F.lit("<td>"), e(F.coalesce(F.try_element_at(r, k["id"]), F.lit("—"))), F.lit("</td>"))), "")
    table = lambda t: F.concat(
        F.lit("<h2>"), e(t["title"]), F.lit("</h2><table><tr>"), F.array_join(F.transform(t["columns"], lambda k: F.concat(F.lit("<th>"), e(k["label"]), F.lit("</th>"))), ""), F.lit("</tr>"),
        F.array_join(F.transform(t["rows"], lambda r: F.concat(F.lit("<tr>"), cells(t, r), F.lit("</tr>"))), ""), F.lit("</table>"),
    )
    said = lambda i: F.concat(F.lit('<li class="'), i["severity"], F.lit('"><b>'), e(i["title"]), F.lit("</b> "), e(i["body"]), F.lit("</li>"))
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), e(c("filename")), F.lit("</title></head><body><h1>"), e(c("filename")), F.lit("</h1><p>"), e(label(c("detected_type"))),
        F.lit(' <span class="'), score_class(c("completeness")), F.lit('">'), c("completeness").cast("string"), F.lit("/100</span></p><table>"), F.array_join(F.transform("fields", field), ""),
        F.lit("</table>"), F.array_join(F.transform("tables", table), ""), F.lit("<ul>"), F.array_join(F.transform("insights", said), ""), F.lit("</ul></body></html>"),
    )
    return results.select("doc_id", page.alias("report"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A table as delimited text: every cell quoted, inner quotes doubled, null empty."""
    rows.write.mode("overwrite").options(header=True, quoteAll=True, escape='"', nullValue="", emptyValue="").csv(path)


def csv_line(cells: list[Column]) -> Column:
    """One such line."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for x in cells])


def xlsx_bytes(title: str, columns: list[str], rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet; its name has thirty characters at most."""
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [columns, *rows])
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    name = escape(title[:30], {'"': "&quot;"})
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def to_xlsx(results: DataFrame) -> DataFrame:
    """``doc_id, table_id, content``: each table of each document as a workbook."""
    t = results.select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.*")
    flat = t.select("doc_id", "id", "title", F.transform("columns", lambda c: c["label"]).alias("labels"), F.transform("rows", lambda r: F.transform(F.col("columns"), lambda c: F.try_element_at(r, c["id"]))).alias("cells"))

    def run(batches):
        for b in batches:
            made = [xlsx_bytes(r.title, list(r.labels), [list(x) for x in r.cells]) for r in b.itertuples()]
            yield pd.DataFrame({"doc_id": b["doc_id"], "table_id": b["id"], "content": made})

    return flat.mapInPandas(run, "doc_id long, table_id string, content binary")


def history_export(docs: DataFrame) -> DataFrame:
    """The six columns of an exported history."""
    names = {"filename": "filename", "detected_type": "type", "classification_confidence": "confidence", "completeness": "completeness", "ocr_used": "ocrUsed", "extracted_at": "extractedAt"}
    return docs.select(*[F.col(a).alias(b) for a, b in names.items()])


def persist_state(docs: DataFrame, corrections: DataFrame, annotations: DataFrame, path: str) -> None:
    """Documents without their results, corrections and annotations as Parquet tables under one folder."""
    for name, df in (("documents", docs.drop("result")), ("corrections", corrections), ("annotations", annotations)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
