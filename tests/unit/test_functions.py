"""Column functions against hand-derived values."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrion.functions import classify, lang, pii, rx, text
from papyrion.operators import ocr


@pytest.fixture(scope="module")
def one(spark):
    def run(value, make, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]

    return run


def test_boundaries_are_ascii(one):
    assert one("été a t", lambda x: F.regexp_count(x, F.lit(rx.rx(r"\bt\b")))) == 2
    assert one("cat concat", lambda x: F.regexp_count(x, F.lit(rx.rx(r"\bcat\b")))) == 1


def test_end_is_the_very_end(one):
    assert one("ab\n", lambda x: rx.has(x, "ab$")) is False and one("ab\ncd", lambda x: rx.has(x, "ab$", "m")) is True


@pytest.mark.parametrize("v, want", [(2.5, 3), (-2.5, -2), (0.49, 0)])
def test_round_half_up(one, v, want):
    assert one(v, rx.js_round, "double") == want


@pytest.mark.parametrize("v, want", [("12abc", 12.0), (" .5", 0.5), ("1.2.3", 1.2), ("x", None), ("", None), ("-7-3", -7.0)])
def test_number_prefix(one, v, want):
    assert one(v, rx.number) == want


def test_dehyphenate_and_white_space(one):
    assert one("compu-\n  ting Re-\nDo", text.dehyphenate) == "computing Re-\nDo"
    assert one("  a \t b  \n\n\n\n c\t\n", text.normalize_whitespace) == "a b\n\n c"


LONG = "this line has more than forty characters in it"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a\nb", "a\n\nb"),
        (f"{LONG}\nand so on", f"{LONG} and so on"),
        (f"{LONG}\nAnd so on", f"{LONG} And so on"),
        (f"{LONG}\nSo on", f"{LONG}\n\nSo on"),
        (f"{LONG}.\nso on", f"{LONG}.\n\nso on"),
        (f"{LONG}\n\nso on", f"{LONG}\n\nso on"),
        ("x" * 40 + "\nso", "x" * 40 + "\n\nso"),
        ("x" * 41 + "\nso", "x" * 41 + " so"),
        (f"{LONG}\nshort one\nthen more", f"{LONG} short one\n\nthen more"),
        ("", ""),
        ("\n\n a \n\n", "a"),
    ],
)
def test_paragraphs(one, raw, want):
    assert one(raw, text.reconstruct_paragraphs) == want


def paragraphs(raw):
    """A walk over the lines, as a check on the pairwise form."""
    import re

    out, buf = [], []
    for line in [x.strip() for x in raw.split("\n")]:
        if not line:
            out, buf = [*out, *([" ".join(buf)] if buf else [])], []
            continue
        if buf:
            goes_on = not re.search(r"[.!?:,;]\s*\Z", buf[-1]) and len(buf[-1]) > 40 and (re.match("[a-z]", line) or re.match(rf"(?i)(?:{text.CONJUNCTIONS})\s", line))
            if not goes_on:
                out, buf = [*out, " ".join(buf)], []
        buf.append(line)
    return "\n\n".join([*out, *([" ".join(buf)] if buf else [])])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "and", LONG, "Big word", "end.", LONG + ",", "so it goes", " "]), max_size=9), min_size=8, max_size=8))
def test_paragraphs_match_a_walk(spark, many):
    raw = ["\n".join(x) for x in many]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(text.reconstruct_paragraphs(F.col("x"))).collect()]
    assert got == [paragraphs(x) for x in raw]


@pytest.mark.parametrize("w, n", [("", 0), ("the", 1), ("table", 2), ("bakes", 1), ("walked", 1), ("rhythm", 1), ("beautiful", 4), ("Mr.", 1), ("strengths", 1)])
def test_syllables(one, w, n):
    assert one(w, text.count_syllables) == n


def test_sentences_and_words(one):
    assert one("One two. Three!  Four? five. 6 x", text.split_sentences) == ["One two.", "Three!", "Four? five.", "6 x"]
    assert one("it's well-known, été 42", text.count_words) == 4
    assert one(" a  b\n", text.raw_word_count) == 2


def test_readability(one):
    r = one("The cat sat on the mat. It was flat.", text.readability)
    # 9 words, 2 sentences, 9 syllables
    assert (r.score, r.grade) == (100.0, 0.0)
    r = one("", text.readability)
    assert (r.score, r.grade) == (100.0, 0.0)


@pytest.mark.parametrize("n, want", [(0, 1), (329, 1), (330, 2), (2200, 10)])
def test_reading_time(one, n, want):
    assert one(n, text.reading_minutes, "long") == want


@pytest.mark.parametrize("raw, want", [('"(x).")', "x"), ("<a>", "a"), ("https://x.y/z).", "https://x.y/z"), ("...", ""), ("a.b", "a.b"), ("“q”", "q")])
def test_clean_span(one, raw, want):
    assert one(raw, text.clean_span) == want


def test_clean_spans_keep_the_first(one):
    assert one(["b.", "a", "b", "."], text.clean_spans, "array<string>") == ["b", "a"]


def test_provenance(one):
    body = "x" * 60 + "NEEDLE" + "y" * 60
    assert one(body, lambda x: text.provenance(F.lit("NEEDLE"), x)) == "..." + "x" * 40 + "NEEDLE" + "y" * 40 + "..."
    assert one("a NEEDLE b", lambda x: text.provenance(F.lit("NEEDLE"), x)) == "a NEEDLE b"
    assert one("none", lambda x: text.provenance(F.lit("NEEDLE"), x)) is None


def test_escape_html(one):
    assert one("<a href=\"x\">'&", text.escape_html) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;"


@pytest.mark.parametrize(
    "t, code, sure",
    [
        ("", "en", "low"),
        ("The cat sat on the mat and looked at the dog", "en", "low"),
        ("el perro y la casa de los niños en que por para con una", "es", "medium"),
        ("el la los las de en que por para con una uno es fue como", "es", "high"),
        ("der die das den dem ein eine und ist nicht von mit sich auf auch als", "de", "high"),
        ("это было на самом деле не так как все думали и он знал", "en", "low"),
        ("的了在是我有和就不人都一上也很到说要去你会着", "en", "low"),
        ("as " * 20, "pt", "medium"),
        ("el la los las de en que", "en", "low"),
    ],
)
def test_language(one, t, code, sure):
    r = one(t, lang.detect_language)
    assert (r.code, r.confidence) == (code, sure)


def find(one, t):
    return [(f.type, f.value, f.masked, f.position, f.severity) for f in one(t, pii.detect)]


@pytest.mark.parametrize(
    "t, want",
    [
        ("ssn 123-45-6789.", [("ssn", "123-45-6789", "123-**-6789", 4, "high")]),
        ("card 4111 1111 1111 1234", [("credit_card", "4111 1111 1111 1234", "****-****-****-1234", 5, "high")]),
        ("call (415) 555-0136 now", [("phone", "(415) 555-0136", "***-***-0136", 5, "medium")]),
        ("mail jo@x.org ab", [("email", "jo@x.org", "**@x.org", 5, "medium")]),
        ("mail joanna@x.org", [("email", "joanna@x.org", "j****a@x.org", 5, "medium")]),
        ("Passport no 123456789", [("national_id", "Passport no 123456789", "Passport no 12*******", 0, "high")]),
        ("DOB: 1/2/1990", [("date_of_birth", "DOB: 1/2/1990", "DOB: **/**/****", 0, "high")]),
        ("a Biopsy today", [("medical_term", "Biopsy", "Biopsy", 2, "medium")]),
        ("", []),
        ("hiv123 chiv", []),
    ],
)
def test_pii_types(one, t, want):
    assert find(one, t) == want


def test_pii_offsets_with_repeats(one):
    t = "x123-45-6789 123-45-6789 and 123-45-6789, jo@x.org jo@x.org"
    assert [(f[0], f[3]) for f in find(one, t)][:2] == [("ssn", 13), ("ssn", 29)] or [f[3] for f in find(one, t) if f[0] == "ssn"] == [13, 29]
    for kind, value, _, at, _ in find(one, t):
        assert t[at : at + len(value)] == value


def test_pii_priority(one):
    # sixteen digits are a card, though ten of them look like a phone
    assert [f[0] for f in find(one, "4111111111111234")] == ["credit_card"]


def test_pii_summary_and_redaction(one):
    t = "jo@x.org, 123-45-6789 and al@y.org; a biopsy"
    assert one(t, lambda x: pii.summarize(pii.detect(x))) == "2 email address(es), 1 SSN(s), 1 medical term(s)"
    assert one("", lambda x: pii.summarize(pii.detect(x))) == "No PII detected."
    assert one(t, lambda x: pii.redact(x, pii.detect(x))) == "**@x.org, 123-**-6789 and **@y.org; a biopsy"
    assert one("a jo@x.org\n\nb", lambda x: pii.redacted_pages(x, pii.detect(x))) == ["a **@x.org", "b"]


@pytest.mark.parametrize(
    "name, kind",
    [("my-invoice.pdf", "invoice"), ("standard.txt", "contract"), ("agenda.txt", "contract"), ("cv.doc", "resume"), ("news-article.txt", "research_paper"), ("PO123.txt", "purchase_order"), ("po-1.txt", None), ("10-K.txt", "financial_statement"), ("lab-report.txt", "medical_report"), ("cover letter.txt", "correspondence"), ("notes.txt", None)],
)
def test_filename_rules(one, name, kind):
    r = one(name, classify.by_filename)
    assert (r and r.type) == kind


def test_content_scores(one):
    t = "Dear Sir\n\nI am writing to you. Yours sincerely"
    r = one(t, lambda x: classify.classify(x, F.lit("a.txt")))
    # 4 of 20 keywords (dear sir, i am writing, yours sincerely, sincerely) times .3 for 9 words, no salutation line
    assert r.type == "general" and r.confidence < 25
    assert one("x", lambda x: classify.classify(x, F.lit("a.txt"), F.lit(True))).type == "spreadsheet"
    forced = one("x", lambda x: classify.classify(x, F.lit("a.txt"), F.lit(False), F.lit("resume")))
    assert (forced.type, forced.confidence) == ("resume", 100)


@pytest.mark.parametrize("t, want", [("", 1.0), ("ab", 0.3), ("55501234", 0.0), ("xkcdwq", 0.8), ("the name of the company", 0.0), ("!!! ???", 1.0), ("XQ ZT WR", 1.0)])
def test_gibberish(one, t, want):
    assert one(t, ocr.gibberish) == pytest.approx(want)


def test_gibberish_knows_the_whole_dictionary(one):
    words = sorted(set(ocr.COMMON_WORDS))
    assert len(words) == 530 and hashlib.md5(" ".join(words).encode()).hexdigest() == "520b75c44f13e66f1e09736d11a1207a"
    assert one("Mother often walks through dark water", ocr.gibberish) == 0.0


def test_ocr_lines(spark):
    rows = [(1, 0, "the name of the company", 90.0), (1, 1, "xkcdwq", 95.0), (1, 2, "the total amount", 20.0), (1, 3, None, None), (2, 0, "your order", 60.0)]
    got = {r.doc_id: r for r in ocr.analyze(spark.createDataFrame(rows, "doc_id long, line_no int, text string, confidence double")).collect()}
    assert got[1].high_text == "the name of the company" and got[1].n_noise == 3 and got[1].mean_confidence == 90.0
    assert got[2].high_ratio == 1.0 and got[2].low_text == ""
