"""What the models are asked; placeholders in braces are filled by ``filled``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t

#: Classify a contract whose keywords leave its field open.
ROUTE = """Name the field of law of the contract below: one of Dân sự, Thương mại, Lao động, Doanh nghiệp.
Answer with JSON only: {"domain": "<field>", "reason": "<one sentence>"}

{contract}"""

#: Split a contract without clear headings.
SPLIT = """Cut the contract below into its clauses, each a unit of meaning, in their own words and unabridged.
Answer with JSON only: {"clauses": ["<first clause>", "<second clause>"]}

{contract}"""

#: Judge a clause against the law that was found for it.
JUDGE = """Check whether the clause of a contract breaks Vietnamese law: find its duties, rights, conditions and terms, hold each against
the law below, and tell breaches from missing content and from unfair terms.  Suggest a wording that the law allows.
Answer with a JSON list only, empty if nothing is wrong: [{"clause": "<words quoted>", "violation": "<what and how>",
"reference_law": "<article and law>", "suggested_fix": "<new wording>"}]

Clause:
{clause}

Law:
{legal_context}"""

#: Write the report on what was found.
REPORT = """Write a report on a contract in Vietnamese, in Markdown: a summary, each violation with clause, violation, legal basis and
suggested wording, and general advice.

Field of law: {domain}

Findings (JSON):
{findings_json}"""

#: Characters of a contract that the first two prompts hold.
CONTRACT_CHARS = 8000


def filled(template: str, **values: t.Text) -> Column:
    """The template with each placeholder replaced; a value's own braces stay as they are, as each piece is filled by itself."""
    import re

    parts = re.split("({" + "}|{".join(values) + "})", template)
    return F.concat(*(t.text(values[x[1:-1]]) if x[1:-1] in values and x.startswith("{") else F.lit(x) for x in parts))
