"""Settings shared by the matching and labelling operators."""

from __future__ import annotations

from dataclasses import dataclass

# Production thresholds of the sentence matcher and the label cut between
# an edited and an unchanged sentence.
SENTENCE_THRESHOLD = 0.44
WORD_CUTOFF = 0.5
UNCHANGED_DISTANCE = 0.01
LSH_BUCKET_LENGTH = 3.0
LSH_TABLES = 3


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds of the matcher.

    ``norm`` picks the word count a distance is divided by: ``own`` uses the sentence whose
    partner is searched, ``x`` always uses the older sentence.
    """

    word_cutoff: float = WORD_CUTOFF
    sentence_threshold: float = SENTENCE_THRESHOLD
    norm: str = "own"
    digits: int = 9
    frequent_words: int = 1000

    def __post_init__(self):
        if self.norm not in ("own", "x"):
            raise ValueError(f"norm must be 'own' or 'x', not {self.norm!r}")
        if not 0 < self.sentence_threshold <= self.word_cutoff:
            raise ValueError("sentence_threshold must lie in (0, word_cutoff]")
