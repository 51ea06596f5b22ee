"""The language model keeps its classes and its step."""

from __future__ import annotations

import inspect

from cadentia.llm import lm


def test_lm_has_its_classes_and_short_steps():
    assert lm.FREQUENT >= 24 and lm.SPELLINGS >= 24 and lm.SPELLINGS & (lm.SPELLINGS - 1) == 0
    assert inspect.signature(lm.score).parameters["run"].default <= 4096
    assert inspect.signature(lm.score).parameters["rounds"].default >= 3 and lm.CELLS >= 16
