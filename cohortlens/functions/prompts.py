"""Prompts of the generation and verification steps as column expressions over report and evidence texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts of the prompts, first for the generation with the image at hand, then neutral as to the input.
FIRST = (
    "Write a concise FINDINGS and IMPRESSION chest radiograph report for the query image. "
    "Use the retrieved reports only as context; do not copy unsupported details. Do not mention retrieval.\n\n"
)
FIRST_NEUTRAL = (
    "Write a concise FINDINGS and IMPRESSION chest radiograph report for the target case. "
    "Use only the supplied evidence. Retrieved reports are examples, not confirmed findings "
    "for this case; do not copy unsupported details. Do not mention retrieval.\n\n"
)
FIRST_END = "\n\nGENERATED REPORT:"
PASS = "Revision pass "
REVISION = (
    ". Recheck the candidate against the query image and retrieved context. "
    "Correct unsupported findings, contradictions, and important omissions. Return only the revised report.\n\n"
)
REVISION_NEUTRAL = (
    ". Recheck the candidate against the supplied evidence. "
    "Correct unsupported findings, contradictions, and important omissions. Return only the revised report.\n\n"
)
CANDIDATE = "CANDIDATE:\n"
REVISION_END = "\n\nREVISED REPORT:"
VERIFIER = "Decide whether the STATEMENT is supported by the EVIDENCE. Output exactly TRUE or FALSE.\n\n"
EVIDENCE, STATEMENT, VERIFIER_END = "EVIDENCE\n", "STATEMENT:\n", "\n\nANSWER:"
RECOVERY = (
    "\n\nThe previous decoding attempt returned no visible text. A report is required. "
    "Do not end the response immediately. Start with FINDINGS and provide at least one "
    "complete FINDINGS sentence followed by one IMPRESSION sentence."
)
OMISSION = "\n\n[Retrieved context shortened for empty-output recovery]\n\n"


def first_prompt(evidence: Column, neutral: bool = False) -> Column:
    return F.concat(F.lit(FIRST_NEUTRAL if neutral else FIRST), evidence, F.lit(FIRST_END))


def revision_prompt(report: Column, evidence: Column, pass_number: Column, neutral: bool = False) -> Column:
    return F.concat(F.lit(PASS), pass_number.cast("string"), F.lit((REVISION_NEUTRAL if neutral else REVISION) + CANDIDATE), report, F.lit("\n\n"), evidence, F.lit(REVISION_END))


def verifier_prompt(report: Column, evidence: Column | None = None) -> Column:
    """With evidence beside the report, or with a report that holds both by itself; a null evidence counts as none."""
    statement = F.trim(report)
    alone = F.when(F.upper(statement).contains("EVIDENCE") & F.upper(statement).contains("STATEMENT"), statement).otherwise(F.concat(F.lit(STATEMENT), statement))
    body = alone if evidence is None else F.when(evidence.isNotNull(), F.concat(F.lit(EVIDENCE), F.trim(evidence), F.lit("\n\n" + STATEMENT), statement)).otherwise(alone)
    return F.concat(F.lit(VERIFIER), body, F.lit(VERIFIER_END))
