"""Queries for the extractors by type: documents rendered from the synthetic customers, and read back.

Each query writes one document per customer, whose parts come and go with the customer's number, and
extracts it. The SQL never sees a text: it says from the number alone what there is to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators import business, letters, medical, resume, scholarly
from papyrion.plans.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FIRST = "Ada Ben Cora Dan Eve Finn Gina Hugo".split()
LAST = "Stone Rivers Moss Hale Lake Brook Frost".split()
TERMS = "Services Fees Site Crew Plan Goods".split()


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _base(duck: bool) -> str:
    """``doc_id, k, name, other, last`` of every customer."""
    pick = (lambda xs, at: "[" + ", ".join(f"'{x}'" for x in xs) + f"][{at} + 1]") if duck else (lambda xs, at: "array(" + ", ".join(f"'{x}'" for x in xs) + f")[cast({at} as int)]")
    first, last, first2, last2 = pick(FIRST, "c_custkey % 8"), pick(LAST, "c_custkey % 7"), pick(FIRST, "(c_custkey + 3) % 8"), pick(LAST, "(c_custkey + 2) % 7")
    return f"select c_custkey as doc_id, c_custkey as k, {first} || ' ' || {last} as name, {first2} || ' ' || {last2} as other, {last2} as last from customer"


def rendered(spark: SparkSession, sf_dir: str, *parts: str, columns: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, filename, text``: the parts (SQL, null ones left out) as lines."""
    spread(table(spark, sf_dir, "customer").select("c_custkey")).createOrReplaceTempView("customer")  # keys take no space, their texts take long
    base = spark.sql(_base(False))
    for name, sql in (columns or {}).items():
        base = base.withColumn(name, F.expr(sql))
    return base.select("doc_id", F.lit("paper.txt").alias("filename"), F.concat_ws("\n", *[F.expr(p) for p in parts]).alias("text"))


def told(found: DataFrame, **columns: str) -> DataFrame:
    """The named details, with the ids and severities of all observations and the completeness."""
    said = "array_join(transform(insights, x -> x.id || '/' || x.severity), '|')"
    return found.select("doc_id", *[F.expr(sql).alias(n) for n, sql in columns.items()], F.expr(said).alias("insights"), "completeness")


def _oracle(columns: dict[str, str], insights: list[tuple[str, str]], complete: list[str], steps: tuple[str, ...] = ()) -> str:
    """SQL of one row per customer; ``steps`` add columns one after the other."""
    source = f"({_base(True)})"
    for step in steps:
        source = f"(select *, {step} from {source})"
    said = "concat_ws('|', " + ", ".join(f"case when {when} then {text} end" for when, text in insights) + ")"
    score = " + ".join(f"coalesce(({c})::int, 0)" for c in complete)
    picked = ", ".join(f"{sql} as {n}" for n, sql in columns.items())
    return f"select doc_id, {picked}, {said} as insights, floor(({score}) * 100.0 / {len(complete)} + 0.5)::int as completeness from {source}"


def structs(array: str, *fields: str) -> str:
    return f"array_join(transform({array}, x -> concat_ws('/', {', '.join('x.' + f for f in fields)})), '|')"


# --- laboratory reports ----------------------------------------------------------------------------

_FLAG = "case when {0} > {1} then 'C' when {0} > {2} then 'H' when {0} < {3} then 'L' else 'N' end"
_MEANING = "case when {0} > {2} and {0} <= {1} or {0} < {3} then 'abnormal' when {0} > {1} then 'critical' else 'normal' end"
_SUGAR, _SALT = ("(k % 150 + 50)", 180, 110, 70), ("(130 + k % 20)", 999, 145, 135)


@query(
    _oracle(
        {
            "status": "status",
            "patient": "'[PATIENT]'",
            "report_date": "'2024-03-' || lpad((k % 28 + 1)::varchar, 2, '0')",
            "physician": "case when k % 4 <> 0 then other end",
            "lab": "'Central ' || (k % 9)",
            "notes": "case when k % 3 = 0 then 'Fasting sample taken at home' end",
            "tests": "concat_ws('|', 'Glucose/' || (k % 150 + 50) || '/mg/dL/70-110/' || sugar, 'Sodium/' || (130 + k % 20) || '/mmol/L/135-145/' || salt, case when k % 2 = 0 then 'Iron/' || (k % 50) || '.5/ug' end)",
            "fields": "concat_ws('|', 'patientName=[PATIENT]', 'dateOfReport=2024-03-' || lpad((k % 28 + 1)::varchar, 2, '0'), 'orderingPhysician=' || case when k % 4 <> 0 then other else '' end, 'labName=Central ' || (k % 9), 'status=' || coalesce(status, '—'), 'testCount=' || (2 + (k % 2 = 0)::int))",
        },
        [
            ("true", "'patient-deidentified/notice'"),
            ("'critical' in (sugar, salt)", "'critical-results/warning'"),
            ("'critical' not in (sugar, salt) and 'abnormal' in (sugar, salt)", "'abnormal-results/notice'"),
            ("k % 4 = 0", "'no-physician/info'"),
        ],
        ["true", "true", "k % 4 <> 0", "true", "true", "status is not null"],
        (
            f"{_MEANING.format(*_SUGAR)} as sugar, {_MEANING.format(*_SALT)} as salt",
            "case when k % 5 = 0 then 'abnormal' when k % 5 = 1 then null when 'critical' in (sugar, salt) then 'critical' when 'abnormal' in (sugar, salt) then 'abnormal' else 'normal' end as status",
        ),
    )
)
def lab_reports(spark, sf_dir):
    docs = rendered(
        spark,
        sf_dir,
        "'Patient: ' || name || ' (' || k || ')'",
        "'Report Date: 2024-03-' || lpad(cast(k % 28 + 1 as string), 2, '0')",
        "if(k % 4 <> 0, 'Ordering Physician: ' || other || ', MD', null)",
        "'Laboratory: Central ' || (k % 9) || ' (main)'",
        "case k % 5 when 0 then 'Overall: abnormal' when 1 then 'Overall: pending' end",
        "''",
        f"'Glucose ' || (k % 150 + 50) || ' mg/dL (70-110) ' || {_FLAG.format(*_SUGAR)}",
        f"'Sodium ' || (130 + k % 20) || ' mmol/L (135-145) ' || {_FLAG.format(*_SALT)}",
        "if(k % 2 = 0, 'Iron ' || (k % 50) || '.5 ug', null)",
        "if(k % 3 = 0, '\\nNotes:\\nFasting sample taken at home\\n\\nEnd', null)",
    )
    return told(
        medical.medical_report(docs), status="details.status", patient="details.patientName", report_date="details.dateOfReport", physician="details.orderingPhysician", lab="details.labName", notes="details.notes",
        tests=structs("details.testResults", "testName", "value", "unit", "referenceRange", "flag"), fields="array_join(transform(fields, f -> f.key || '=' || coalesce(f.value, '')), '|')",
    )


# --- transcripts -----------------------------------------------------------------------------------

_GPA = "((k % 24) * 0.1 + 1.7)"


@query(
    _oracle(
        {
            "student": "name",
            "school": "'Stonefield'",
            "degree": "case when k % 3 = 0 then 'Bachelor of Science in Mathematics' else 'Master of Arts in History' end",
            "gpa": f"round({_GPA}, 1)::double",
            "major": "case when k % 4 = 0 then 3.2::double end",
            "scale": "case when k % 2 = 0 then 5.0 else 4.0 end::double",
            "credits": "case when k % 5 <> 0 then (90 + k % 40)::double end",
            "terms": "concat_ws('|', 'Fall/2021', 'Spring/2022', case when k % 3 = 1 then 'Semester 3' end)",
            "courses": "concat_ws('|', 'MATH 101/Calculus/4.0/A', 'PHYS 2' || lpad((k % 90)::varchar, 2, '0') || '/Optics/3.0/B+', 'CHEM 110/Slow Reactions/3.5/C-', case when k % 3 = 1 then 'HIST 300/Empires/3.0/P' end)",
            "dean": "case when k % 6 = 0 then 'Dean''s List — Fall 2021' else '' end",
            "graduation": "case when k % 7 <> 0 then 'May 2025' end",
        },
        [("gpa >= 3.7", "'high-gpa/info'"), ("gpa < 2.0", "'low-gpa/warning'"), ("k % 6 = 0", "'deans-list/info'")],
        ["true", "true", "true", "true", "true", "k % 5 <> 0", "k % 7 <> 0"],
        (f"round({_GPA}, 1) as gpa",),
    ).replace(f"round({_GPA}, 1)::double as gpa", "gpa::double as gpa")
)
def transcripts(spark, sf_dir):
    docs = rendered(
        spark,
        sf_dir,
        "'Student: ' || name || ' (' || k || ')'",
        "'University of Stonefield (main)'",
        "if(k % 3 = 0, 'Bachelor of Science in Mathematics', 'Master of Arts in History')",
        f"'Cumulative GPA: ' || cast(round({_GPA}, 1) as decimal(3,1)) || if(k % 2 = 0, '/5.0', '')",
        "if(k % 4 = 0, 'Major GPA: 3.2', null)",
        "if(k % 5 <> 0, 'Total Credits: ' || (90 + k % 40), null)",
        "if(k % 7 <> 0, 'Graduation: May 2025', null)",
        "''",
        "'Fall 2021' || if(k % 6 = 0, ' - Dean\\'s List', '')",
        "'MATH 101 Calculus 4 A'",
        "'PHYS 2' || lpad(cast(k % 90 as string), 2, '0') || ' Optics 3 B+'",
        "''",
        "'Spring 2022'",
        "'CHEM 110 Slow Reactions 3.5 C-'",
        "'--------------------------------'",
        "if(k % 3 = 1, 'Semester 3\\nHIST 300 Empires 3 P', null)",
    )
    return told(
        scholarly.academic_transcript(docs), student="details.studentName", school="details.institution", degree="details.degreeProgram", gpa="details.overallGPA", major="details.majorGPA", scale="details.gpaScale",
        credits="details.totalCreditsEarned", terms=structs("details.terms", "name", "year"), courses=structs("flatten(details.terms.courses)", "code", "title", "credits", "grade"),
        dean="array_join(details.deansList, '|')", graduation="details.graduationDate",
    )


# --- financial statements --------------------------------------------------------------------------

_MONEY = {"revenue": "(1000 + k * 37)", "income": "((k % 50 - 10) * 5)", "assets": "(5000 + k * 11)", "debts": "((5000 + k * 11) * (k % 90) {div} 100)", "own": "((5000 + k * 11) - (5000 + k * 11) * (k % 90) {div} 100)"}
_HERE = {n: x.format(div="div") for n, x in _MONEY.items()}
_THERE = {n: x.format(div="//") for n, x in _MONEY.items()}


@query(
    _oracle(
        {
            "company": "last || ' Works Inc.'",
            "kind": "kind",
            "period": "case when k % 4 <> 0 then 'December 31, 2023' end",
            "notes": "(k % 4)::int",
            "figures": "concat_ws('/', " + ", ".join(f"{x}::double" for x in _THERE.values()) + ")",
            "shown": "concat_ws('/', " + ", ".join(f"'$' || format('{{:,.2f}}', {x}::double)" for x in _THERE.values()) + ")",
        },
        [
            (f"{_THERE['income']} <> 0", "'profit-margin/info'"),
            (f"{_THERE['debts']} <> 0", f"'debt-ratio/' || case when {_THERE['debts']} * 100.0 / {_THERE['assets']} > 70 then 'warning' else 'info' end"),
            ("true", "'equity-ratio/info'"),
        ],
        ["true", "true", "k % 4 <> 0", "true", f"{_THERE['income']} <> 0", "true", f"{_THERE['debts']} <> 0", "true"],
        ("case when k % 3 = 0 then 'Balance Sheet' else 'Income Statement' end as kind",),
    )
)
def financial_statements(spark, sf_dir):
    shown = lambda label, x: f"'{label} $' || format_number(cast({_HERE[x]} as double), 2)"
    docs = rendered(
        spark,
        sf_dir,
        "last || ' Works Inc.'",
        "case k % 3 when 0 then 'BALANCE SHEET' when 1 then 'INCOME STATEMENT' else 'CASH FLOW STATEMENT' end",
        "if(k % 4 <> 0, 'For the year ended December 31, 2023', null)",
        "''",
        shown("Revenue", "revenue"),
        shown("Net Income", "income"),
        shown("Total Assets", "assets"),
        shown("Total Liabilities", "debts"),
        shown("Total Equity", "own"),
        "if(k % 4 = 0, null, array_join(transform(sequence(1, cast(k % 4 as int)), i -> 'Note ' || i), '\\n'))",
    )
    names = ("revenue", "netIncome", "totalAssets", "totalLiabilities", "equity")
    return told(
        business.financial_statement(docs), company="details.companyName", kind="details.statementType", period="details.statementPeriod", notes="details.footnotesCount",
        # decimals: doubles of ten million and more are cast to text with an exponent
        figures="concat_ws('/', " + ", ".join(f"regexp_replace(cast(cast(details.{n} as decimal(38, 2)) as string), '0$', '')" for n in names) + ")",
        shown="array_join(transform(filter(fields, f -> f.group = 'figures'), f -> f.value), '/')",
    )


# --- papers ----------------------------------------------------------------------------------------

_SHORT = "'We study ' || k || ' rivers and the stones in them'"
_ABSTRACT = f"case when k % 7 = 0 then null when k % 3 = 0 then concat_ws(', ', {_SHORT}, {_SHORT}, {_SHORT}, {_SHORT}, {_SHORT}, {_SHORT}) else {_SHORT} end"


@query(
    _oracle(
        {
            "title": "'A Study of Rivers and Stones in Valley ' || k",
            "authors": "case when k % 5 = 0 then name else name || '|' || other end",
            "abstract": "abstract",
            "keywords": "case when k % 2 = 0 then 'rivers|stones|deep valleys' else '' end",
            "sections": "concat_ws('|', '1. Introduction/1', case when k % 2 = 0 then '2. Method/1|2.1. Sampling/2' end, case when k % 3 = 0 then '3. Results/1' end, case when k % 5 = 0 then '4. Conclusion/1' end)",
            "cited": "(4 + k % 4)::int",
            "refs": "concat_ws('|', case when k % 4 > 0 then '[1] Moss, River beds, 2001' end, case when k % 4 > 1 then '[2] Moss, River beds, 2002' end, case when k % 4 > 2 then '[3] Moss, River beds, 2003' end)",
        },
        [("abstract is null", "'no-abstract/warning'"), ("length(abstract) < 200", "'short-abstract/notice'"), ("k % 4 = 0", "'citations-no-refs/warning'"), ("true", "'missing-sections/notice'")],
        ["true", "true", "abstract is not null", "true", "k % 4 > 0"],
        (f"{_ABSTRACT} as abstract",),
    )
)
def research_papers(spark, sf_dir):
    docs = rendered(
        spark,
        sf_dir,
        "'A Study of Rivers and Stones in Valley ' || k",
        "if(k % 5 = 0, name, name || if(k % 2 = 0, ', ', ' and ') || other)",
        f"'Abstract:\\n' || {_ABSTRACT} || '\\n'",
        "if(k % 2 = 0, 'Keywords: rivers, stones; deep valleys\\n', null)",
        "'1. Introduction.\\nearlier work [1] and [2, 3] (Stone 2001)'",
        "if(k % 2 = 0, '2. Method.\\nas before\\n2.1 Sampling.\\nby hand', null)",
        "if(k % 3 = 0, '3. Results.\\nas told', null)",
        "if(k % 5 = 0, '4. Conclusion.\\nas seen', null)",
        "''",
        "'References\\n' || if(k % 4 = 0, '', array_join(transform(sequence(1, cast(k % 4 as int)), i -> '[' || i || '] Moss, River beds, 200' || i), '\\n'))",
    )
    return told(
        scholarly.research_paper(docs), title="details.title", authors="array_join(details.authors, '|')", abstract="details.abstract", keywords="array_join(details.keywords, '|')",
        sections=structs("details.sections", "heading", "level"), cited="details.citationCountEstimate", refs="array_join(details.references, '|')",
    )


# --- contracts -------------------------------------------------------------------------------------

_PARTY = ("last || ' Works ' || k", "'Moss Group ' || (k % 9)")


@query(
    _oracle(
        {
            "parties": f"case when k % 4 = 0 then {_PARTY[0]} else {_PARTY[0]} || '|' || {_PARTY[1]} end",
            "starts": "starts",
            "ends": "ends",
            "terms": "array_to_string(list_transform(list_slice(['" + "', '".join(TERMS) + "'], 1, case when k % 6 = 0 then 6 else 2 end), lambda t: t || '/work done in region ' || k), '|')",
            "sections": "'1./Scope|2./Payment Terms'",
            "risks": "concat_ws('|', case when k % 5 = 0 then 'indemnification/notice/The parties indemnify each other.' end, case when k % 2 = 0 then 'non_compete/warning/Both sides keep a non-compete rule for ' || k || ' months.' end, case when k % 3 = 0 then 'governing_law/info/The governing law is that of Ruritania.' end)",
            "duties": "'Provider shall deliver the goods to site ' || k || '.'",
        },
        [
            ("k % 2 = 0", "'high-risk-clauses/warning'"),
            ("k % 5 = 0", "'clause-indemnification/notice'"),
            ("k % 2 = 0", "'clause-non_compete/warning'"),
            ("k % 4 = 0", "'missing-parties/warning'"),
            ("starts is null", "'no-effective-date/notice'"),
            ("k % 6 = 0", "'defined-terms-density/info'"),
        ],
        ["k % 4 <> 0", "starts is not null", "true", "true", "k % 2 = 0 or k % 3 = 0 or k % 5 = 0", "true"],
        ("case when k % 3 <> 0 then 'December 31, 2025' end as ends", "case when k % 5 <> 0 then 'January ' || (k % 28 + 1) || ', 2024' else ends end as starts"),
    )
)
def contracts(spark, sf_dir):
    docs = rendered(
        spark,
        sf_dir,
        "'SERVICE AGREEMENT'",
        f"if(k % 4 = 0, 'Client: ' || {_PARTY[0]} || '.', 'This is made between ' || {_PARTY[0]} || ' and ' || {_PARTY[1]} || '.')",
        "if(k % 5 <> 0, 'Effective Date: January ' || (k % 28 + 1) || ', 2024', null)",
        "if(k % 3 <> 0, 'Termination Date: December 31, 2025', null)",
        "'1. Scope.'",
        *[f"if({'true' if n < 2 else 'k % 6 = 0'}, '\"{t}\" means work done in region ' || k || '.', null)" for n, t in enumerate(TERMS)],
        "'2. Payment Terms.'",
        "'Provider shall deliver the goods to site ' || k || '.'",
        "if(k % 5 = 0, 'The parties indemnify each other.', null)",
        "if(k % 2 = 0, 'Both sides keep a non-compete rule for ' || k || ' months.', null)",
        "if(k % 3 = 0, 'The governing law is that of Ruritania.', null)",
    )
    return told(
        letters.contract(docs), parties="array_join(details.parties, '|')", starts="details.effectiveDate", ends="details.terminationDate", terms=structs("details.definedTerms", "term", "definition"),
        sections=structs("details.sections", "number", "title"), risks=structs("details.riskClauses", "type", "severity", "excerpt"), duties="array_join(details.obligations, '|')",
    )


# --- letters ---------------------------------------------------------------------------------------


@query(
    _oracle(
        {
            "kind": "case when k % 2 = 1 then 'business_request' else 'general' end",
            "salutation": "'Dear Mr. ' || last",
            "recipient": "last",
            "subject": "case when k % 5 <> 0 then 'Delivery of goods ' || k end",
            "dated": "'March ' || (k % 28 + 1) || ', 2024'",
            "sender": "name",
            "closing": "'Sincerely,'",
            "signature": "name",
            "reference": "case when k % 3 = 0 then 'AB-' || k end",
            "asks": "concat_ws('|', case when k % 2 = 1 then last || ', We request a delivery for order ' || k end, case when k % 7 <> 0 then 'Please send ' || (k % 9) || ' boxes soon' end)",
            "emails": "case when k % 4 = 0 then 'post' || k || '@example.org' else '' end",
            "copies": "case when k % 6 = 0 then other || '|Cora Lake' else '' end",
            "summary": "case when k % 2 = 1 then 'We request a delivery for order ' || k || '.' else 'Your order ' || k || ' is on its way.' end || case when k % 7 <> 0 then ' Please send ' || (k % 9) || ' boxes soon.' else '' end",
        },
        [("true", "'letter-type/info'"), ("k % 2 = 1 or k % 7 <> 0", "'requests-found/info'"), ("k % 6 = 0", "'cc-found/info'"), ("k % 5 = 0", "'no-subject/notice'")],
        ["true", "true", "k % 5 <> 0", "true", "true", "true", "true", "true", "k % 4 = 0", "k % 2 = 1 or k % 7 <> 0"],
    )
)
def business_letters(spark, sf_dir):
    docs = rendered(
        spark,
        sf_dir,
        "name",
        "k || ' River Road'",
        "if(k % 4 = 0, 'post' || k || '@example.org', null)",
        "''",
        "'March ' || (k % 28 + 1) || ', 2024'",
        "if(k % 5 <> 0, 'Subject: Delivery of goods ' || k, null)",
        "''",
        "'Dear Mr. ' || last || ','",
        "if(k % 2 = 1, 'We request a delivery for order ' || k || '.', 'Your order ' || k || ' is on its way.')",
        "if(k % 7 <> 0, 'Please send ' || (k % 9) || ' boxes soon.', null)",
        "'Sincerely,'",
        "name",
        "if(k % 6 = 0, 'CC: ' || other || '; Cora Lake', null)",
        "if(k % 3 = 0, 'Sr. No: AB-' || k, null)",
    )
    return told(
        letters.correspondence(docs), kind="details.letterType", salutation="details.salutation", recipient="details.recipient", subject="details.subject", dated="details.date", sender="details.sender",
        closing="details.closing", signature="details.signatureName", reference="details.referenceNumber", asks="array_join(details.requests, '|')", emails="array_join(details.emails, '|')",
        copies="array_join(details.ccRecipients, '|')", summary="details.bodySummary",
    )


# --- resumes ---------------------------------------------------------------------------------------

_MONTHS = {"s1": "(2010 + k % 5) * 12 + k % 12", "e1": "s1 + 12 + k % 24", "s2": "e1 + 1 + k % 10", "e2": "s2 + 10 + k % 7"}


def _month(x: str, duck: bool) -> str:
    return f"(({x}) // 12 || '-' || lpad((({x}) % 12 + 1)::varchar, 2, '0'))" if duck else f"(({x}) div 12 || '-' || lpad(cast(({x}) % 12 + 1 as string), 2, '0'))"


_D = {m: _month(m, True) for m in _MONTHS}
_BULLETS = "case when k % 6 <> 0 then 'Led ' || (k % 40 + 2) || ' people' else '' end"


@query(
    _oracle(
        {
            "name": "name",
            "email": "case when k % 5 <> 0 then 'post' || k || '@example.org' end",
            "phone": "case when k % 3 <> 0 then '555-010-' || lpad((k % 10000)::varchar, 4, '0') end",
            "location": "'Springfield, IL'",
            "links": "'linkedin.com/in/person-' || k",
            "summary": "'Builds data systems for ' || k || ' teams.'",
            "jobs": f"'Engineer/Acme Labs/' || {_D['s1']} || '/' || {_D['e1']} || '/' || (e1 - s1 + 1) || '/' || {_BULLETS} || '|Director/River Bank/' || {_D['s2']} || '/' || case when k % 2 = 0 then 'now' else {_D['e2']} end || '/' || late || '/'",
            "schools": "'River University/Master/Science/' || (2000 + k % 9) || '-01'",
            "known": "'Python, SQL' || ';' || case k % 3 when 0 then 'React' when 1 then 'Django' else '' end || ';' || 'Docker' || case when k % 4 = 0 then ', AWS' else '' end || ';' || case when k % 2 = 0 then 'leadership' else '' end || ';Weaving, Knots'",
            "certs": "case when k % 5 <> 1 then 'Safety Level ' || (k % 4) else '' end",
            "projects": "'Bridge/a span made of wood'",
            "papers": "'On bridges and rivers, 2019'",
            "years": "years",
            "gaps": f"case when k % 10 > 0 then {_D['e1']} || '/' || {_D['s2']} || '/' || (s2 - e1) else '' end",
            "ats": "concat_ws('|', case when k % 2 = 0 then 'Leadership' end, case when k % 4 = 0 then 'Cloud' end, 'CI/CD', case when k % 3 = 0 then 'Frontend framework' end, case when k % 3 = 1 then 'Backend framework' end)",
        },
        [
            ("k % 15 = 0", "'no-contact/warning'"),
            ("k % 10 > 0", f"'gap-' || {_D['e1']} || '-' || {_D['s2']} || '/' || case when s2 - e1 >= 6 then 'notice' else 'info' end"),
            ("years >= 10", "'senior/info'"),
            ("true", "'ats-gaps/notice'"),
            ("k % 6 = 0", "'no-bullets/warning'"),
        ],
        ["true", "k % 5 <> 0", "k % 3 <> 0", "true", "true", "true", "true", "true", "true", "k % 5 <> 1"],
        (*[f"{x} as {m}" for m, x in _MONTHS.items()], "(case when k % 2 = 0 then 2024 * 12 else e2 end) - s2 + 1 as late", "floor((e1 - s1 + 1 + late) / 12 * 10 + 0.5) / 10 as years"),
    )
)
def resumes(spark, sf_dir):
    d = {m: _month(m, False) for m in _MONTHS}
    docs = rendered(
        spark,
        sf_dir,
        "name",
        "'Springfield, IL'",
        "if(k % 5 <> 0, 'post' || k || '@example.org', null)",
        "if(k % 3 <> 0, '555-010-' || lpad(cast(k % 10000 as string), 4, '0'), null)",
        "'linkedin.com/in/person-' || k",
        "'Summary\\nBuilds data systems for ' || k || ' teams.'",
        "'Work Experience:'",
        f"'Engineer | Acme Labs | ' || {d['s1']} || ' - ' || {d['e1']}",
        "if(k % 6 <> 0, '- Led ' || (k % 40 + 2) || ' people', null)",
        f"'Director | River Bank | ' || {d['s2']} || ' - ' || if(k % 2 = 0, 'present', {d['e2']})",
        "'Education\\nMaster of Science, River University, ' || (2000 + k % 9)",
        "'Technical Skills\\nPython, SQL, Docker' || case k % 3 when 0 then ', React' when 1 then ', Django' else '' end || if(k % 4 = 0, ', AWS', '') || if(k % 2 = 0, ', leadership', '')",
        "'Other skills: Weaving, Knots'",
        "if(k % 5 <> 1, 'Certifications\\n- Safety Level ' || (k % 4), null)",
        "'Projects\\nBridge - a span\\nmade of wood'",
        "'Publications\\nOn bridges and rivers, 2019'",
        columns=_MONTHS,
    )
    jobs = "array_join(transform(details.experience, x -> concat_ws('/', x.title, x.company, x.startDate, coalesce(x.endDate, 'now'), x.durationMonths, array_join(x.bullets, ', '))), '|')"
    skills = "details.skills"
    return told(
        resume.resume(docs), name="details.contact.name", email="details.contact.email", phone="details.contact.phone", location="details.contact.location", links="array_join(details.contact.links.url, '|')",
        summary="details.summary", jobs=jobs, schools=structs("details.education", "institution", "degree", "field", "graduationDate"),
        known="concat_ws(';', " + ", ".join(f"array_join({skills}.{c}, ', ')" for c in ("languages", "frameworks", "tools", "soft", "other")) + ")",
        certs="array_join(details.certifications, '|')", projects=structs("details.projects", "name", "description"), papers="array_join(details.publications, '|')", years="details.derived.totalYearsExperience",
        gaps=structs("details.derived.gaps", "from", "to", "months"), ats="array_join(transform(filter(details.derived.atsKeywordCoverage, a -> a.hit), a -> a.category), '|')",
    )
