"""The bounds of the fitting samples."""

from __future__ import annotations

from kinloom.llm import quality, toxicity


def test_samples_are_not_cut_to_fit_a_limit():
    assert (toxicity.POSITIVES, toxicity.UNLABELLED, quality.SAMPLE) == (4_000, 12_000, 16_000)
