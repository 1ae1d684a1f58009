"""The generation state machine with pluggable models: one pass, unconditional revisions, or a verifier before each revision.

The machine is a table: a state and what its step found give the next state, or the reason to stop. A step is a call of the
model (a first report, a revision) or of the verifier. Rows go through it in batches; models are plain callables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from cohortlens.sources.shared import bounded_batches

Generate = Callable[[str], str]
#: (report, evidence, condition) to a verdict, None if the verifier's output can't be read.
Verify = Callable[[str, str, str], bool | None]

# The conditions and the input arms.
CONDITIONS = ("A_single_pass", "B_unconditional", "C_pretrained_gate", "D_corrected_lora_gate")
ARMS = ("retrieved_text_only", "retrieved_text_plus_image")

KIND = dict(zip(CONDITIONS, ("single", "open", "gated", "gated"), strict=True))
# (state, what its step found): next state. Words in quotes without a state of that name are reasons to stop (fixed values).
TABLE = {
    ("first", "blank"): "empty_initial_after_recovery",
    ("first", "single"): "single_pass",
    ("first", "open"): "revise",
    ("first", "gated"): "judge",
    ("first", "exhausted"): "max_passes",
    ("judge", "accepted"): "verifier_true",
    ("judge", "not accepted"): "revise",
    ("revise", "blank"): "empty_revision_fallback",
    ("revise", "open"): "revise",
    ("revise", "gated"): "judge",
    ("revise", "exhausted"): "max_passes",
}


class Unusable(RuntimeError):
    """A matched-input record can't be completed: a report stays blank, or a verdict can't be read."""


@dataclass
class Run:
    condition: str
    reports: list[str] = field(default_factory=list)
    verdicts: list[bool | None] = field(default_factory=list)
    recovered: int = 0
    stop_reason: str = ""

    @property
    def report(self) -> str:
        """The last report that isn't blank."""
        return next((r for r in reversed(self.reports) if r.strip()), "")


@dataclass
class Models:
    """What a run calls: the model with its prompts and the one retry after a blank output, and the verifier."""

    generate: Generate
    verify: Verify
    first: Callable[[str], str]
    revise: Callable[[str, str, int], str]
    recovery: Callable[[str], str] = lambda prompt: prompt
    passes: int = 4

    def draft(self, run: Run, prompt: str) -> str:
        """Generate into the run; what was found there: blank, exhausted, or the condition's kind."""
        text = self.generate(prompt)
        if not text.strip():
            run.recovered += 1
            text = self.generate(self.recovery(prompt))
        run.reports.append(text)
        kind = KIND[run.condition]
        if not text.strip():
            return "blank"
        return "exhausted" if kind != "single" and len(run.reports) > self.passes else kind

    def step(self, state: str, run: Run, evidence: str) -> str:
        if state == "judge":
            run.verdicts.append(self.verify(run.report, evidence, run.condition))
            return "accepted" if run.verdicts[-1] is True else "not accepted"
        return self.draft(run, self.first(evidence) if state == "first" else self.revise(run.report, evidence, len(run.reports)))


def run_condition(condition: str, evidence: str, models: Models) -> Run:
    """Follow the table from the first report to a reason to stop."""
    run, state = Run(condition), "first"
    if condition not in KIND:
        raise ValueError(condition)
    states = {s for s, _ in TABLE}
    while state in states:
        state = TABLE[state, models.step(state, run, evidence)]
    run.stop_reason = state
    return run


def run_matched(condition: str, arm: str, entry: dict, generate: Callable[[str, str | None], str], verify: Callable[[str, str, str, str | None], bool | None], first, revise, passes: int = 4) -> Run:
    """A run in one input arm: the image goes to the model and the verifier in the second arm only, the prompts are the same.

    A blank report gets one retry with the identical prompt; if it stays blank, or a verdict is neither true nor false, the
    record isn't complete and Unusable is raised.
    """
    if arm not in ARMS:
        raise ValueError(arm)
    image = entry["image_path"] if arm == ARMS[1] else None

    def readable(report: str, evidence: str, condition: str) -> bool:
        verdict = verify(report, evidence, condition, image)
        if verdict not in (True, False):
            raise Unusable("the verdict can't be read")
        return verdict

    run = run_condition(condition, entry["evidence"], Models(lambda prompt: generate(prompt, image), readable, first, revise, passes=passes))
    if run.stop_reason.startswith("empty_"):
        raise Unusable(f"no report after {len(run.reports)} passes and their retries")
    return run


SCHEMA = "record_id string, condition string, final_report string, n_reports int, n_verdicts int, n_recovered int, stop_reason string, stopping_pass int"


def run_all(df: DataFrame, models: Models) -> DataFrame:
    """Every row (record_id, condition, evidence) through its condition, row by row in batches of bounded size; see SCHEMA."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record_id, condition, evidence in zip(batch["record_id"], batch["condition"], batch["evidence"], strict=True):
                run = run_condition(condition, evidence or "", models)
                rows.append((record_id, condition, run.report, len(run.reports), len(run.verdicts), run.recovered, run.stop_reason, len(run.reports) - 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    bounded_batches(df.sparkSession)
    return df.select("record_id", "condition", "evidence").mapInPandas(work, SCHEMA)


MATCHED = "record_id string, condition string, arm string, final_report string, n_reports int, n_verdicts int, n_recovered int, stop_reason string, error string"


def run_matched_all(df: DataFrame, generate, verify, first, revise, passes: int = 4) -> DataFrame:
    """Every row (record_id, condition, arm, evidence, image_path) in its arm; see MATCHED. A record that can't be completed
    has an error and no report: failures stand apart and the others go on."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    run = run_matched(row.condition, row.arm, {"evidence": row.evidence or "", "image_path": row.image_path}, generate, verify, first, revise, passes)
                    rows.append((row.record_id, row.condition, row.arm, run.report, len(run.reports), len(run.verdicts), run.recovered, run.stop_reason, None))
                except Unusable as error:
                    rows.append((row.record_id, row.condition, row.arm, None, None, None, None, None, str(error)))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHED.split(", ")])
            yield frame.astype({c: "Int32" for c in ("n_reports", "n_verdicts", "n_recovered")})

    bounded_batches(df.sparkSession)
    return df.select("record_id", "condition", "arm", "evidence", "image_path").mapInPandas(work, MATCHED)
