"""Texts written for the tests, two or so of each kind."""

INVOICE = """Northwind Traders LLC
12 Harbour Road
billing@northwind.example

Invoice No: INV-20931
Date: 03/15/2024
Due: 2024-04-14

Bill To: Acme Rockets
5 Canyon Street
ap@acme.example

Description Qty Unit Price Amount
Steel brackets 4 $25.00 $100.00
Copper wire 10 $3.50 $35.00

Subtotal $135.00
Tax (8%) $10.80
Total Due $145.80
"""

ORDER = """Purchase Order
PO Number: PO-77120
Date: 2024-02-01
Buyer: Contoso Mills
Vendor: Fabrikam Supply
Ship To: 9 Dock Lane

Item Qty Unit Price
Paper rolls 3 $20.00 $60.00
Ink 2 $15.00 $30.00
Subtotal: $90.00
Freight: $12.50
Grand Total: $102.50
Payment Terms: Net 45
Authorized by: Dana Fields
Delivery Date: 2024-02-20
"""

CONTRACT = """SERVICE AGREEMENT

This Agreement is made between Alpha Works Inc and Beta Holdings Ltd, with an effective date: January 5, 2024.

WHEREAS the parties wish to work together.

1. Definitions
"Confidential Information" means all data that one party gives the other.
2. Term and Termination
The agreement shall automatically renew for successive terms. Either party may end it with termination for convenience.
3. Indemnification
The Supplier shall indemnify the Client against all claims of third parties.
4. Governing Law
The governing law is that of Ruritania.
"""

PAPER = """Sparse Methods for Large Archives of Text
Ana Lima, Bo Chen and Carla Diaz

Abstract
We present a way to sort large archives of text that needs little memory. It works in one pass and keeps the order of equal keys, which earlier ways did not, and it is fast in practice on real data of many kinds.

Keywords: sorting, archives; memory

1. Introduction
Sorting is old [1, 2] and much studied (Knuth, 1973).
2. Methods
2.1 Data
We use archives [3].
References
[1] A. Lima. Sorting things. 2001.
[2] B. Chen. More sorting. 2005.
[3] C. Diaz. Archives. 2011.
"""

TRANSCRIPT = """Riverside University
Student: Maya Holt
Bachelor of Science in Physics

Fall 2021
PHY 101 Mechanics 4.0 A
MAT 110 Calculus I 3.0 B+
Dean's List
Spring 2022
PHY 102 Waves 4.0 A-

Cumulative GPA: 3.75/4.0
Total Credits Earned: 11.0
Graduation: May 2024
"""

FINANCIAL = """Consolidated Balance Sheet
Umbra Energy Corp
For the year ended December 31, 2023

Total Revenue $5,000,000.00
Net Income $750,000.00
Total Assets $9,000,000.00
Total Liabilities $6,750,000.00
Total Equity $2,250,000.00
See note 1 and note 2.
"""

MEDICAL = """Laboratory: Central Diagnostics
Patient: John Carter
Report date: 2024-05-02
Ordering Physician: Dr Vera Stone

Hemoglobin 10.1 g/dL (12.0-16.0) L
Glucose 90 mg/dL (70-100) N
Potassium 6.9 mmol/L (3.5-5.1) C

Interpretation:
The potassium is far above its range and must be checked again today.

End of report
"""

LETTER = """Jane Porter
14 Elm Street
jane@porter.example

March 3, 2024

Subject: Broken heater

Dear Mr. Oliver Grant

I am writing because the heater in flat 9 broke. I wish to report that it is unacceptable. Please kindly review the matter and send someone this week.

CC: Ann Lee; Tom Ray

Sincerely,
Jane Porter
"""

RESUME = """Priya Nair
priya.nair@mail.example | 415-555-0136 | https://github.com/pnair
Austin, TX

Summary
Engineer who builds data systems.

Experience
Engineer - Globex | 2018-03 - 2020-06
• Built pipelines in Python that cut cost by 30%
Analyst - Initech | 2021-01 - present
• Led reports for 12 teams

Education
B.S. in Computer Science, Riverside University, 2017

Skills
Skills: Python, SQL, Docker, Gardening

Certifications
- Cloud practitioner
"""

GENERAL = """# Walking Notes

The river path is long. It starts near the old mill, and it was opened on 2021-05-04. Write to walks@paths.example or see https://paths.example/map for more.

## Places

We met Robert Hale, who was presented by Helen Moss at Riverside University. Tickets cost $12.50 in New York.

CLOSING WORDS

Walk well.
"""

CSV = "name,amount,day\nAda,1.50,2024-01-02\nBob,2.25,2024-01-03\nBob,2.25,2024-01-03\n,,\n"

TYPED = [
    ("invoice", INVOICE),
    ("purchase_order", ORDER),
    ("contract", CONTRACT),
    ("research_paper", PAPER),
    ("academic_transcript", TRANSCRIPT),
    ("financial_statement", FINANCIAL),
    ("medical_report", MEDICAL),
    ("correspondence", LETTER),
    ("resume", RESUME),
    ("general", GENERAL),
    ("spreadsheet", CSV),
]
