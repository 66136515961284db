"""The passes over a timeline's packed cues, in their order.

The six last ones are mandatory: an error in one carries its code and ends the job;
those before are optional and left out where they fail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from cuesmith.functions.layout import Spec
from cuesmith.operators import cues as Q
from cuesmith.operators import optimizer, shaping, speech
from cuesmith.operators.cues import Cue

Pass = Callable[[list[Cue], Spec], Iterable[Cue]]
OPTIONAL: list[tuple[str, Pass]] = [
    ("shaping", shaping.shape), ("sequence_optimizer", optimizer.optimize), ("readability", lambda c, s: shaping.fit_lines(Q.readability(c, s), s)),
    ("sequence_optimizer", optimizer.optimize), ("condensation", speech.condense),
]
MANDATORY: list[tuple[str, Pass]] = [
    ("sequence_optimizer", partial(optimizer.optimize, repair_only=True, deferred=True)), ("cpl_fit", shaping.fit_lines), ("frame_grid", Q.to_grid),
    ("label_suppression", speech.suppress_labels), ("capitalization", speech.capitalize),
]


class MandatoryStageError(RuntimeError):
    """A mandatory pass failed; ``code`` names it."""

    def __init__(self, stage: str, cause: Exception):
        self.code = f"MANDATORY_STAGE_{stage.upper()}_FAILED"
        super().__init__(f"{self.code}: {cause}")


def format_cues(cues: list[Cue], spec: Spec, optional: list[tuple[str, Pass]] | None = None, mandatory: list[tuple[str, Pass]] | None = None) -> list[Cue]:
    for _, change in OPTIONAL if optional is None else optional:
        try:
            cues = list(change(cues, spec))
        except Exception:  # an optional pass is left out
            continue
    for stage, change in MANDATORY if mandatory is None else mandatory:
        try:
            cues = list(change(cues, spec))
        except Exception as e:
            raise MandatoryStageError(stage, e) from e
    return cues
