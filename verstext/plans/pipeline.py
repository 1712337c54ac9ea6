"""The scoring steps as stages of an ML pipeline, for jobs that are put together that way."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame

from verstext.config import MatchConfig

KEYS = "entry_id, version_x, version_y"
BOTH = f"{KEYS}, sent_idx_x, sent_idx_y"


def scoring_pipeline(side: str, config: MatchConfig = MatchConfig()) -> Pipeline:
    """Word minimum, sentence distance, best match and threshold for one side of the word pairs."""
    other = "y" if side == "x" else "x"
    count = "num_words_x" if config.norm == "x" else f"num_words_{side}"
    c, t, d = config.word_cutoff, config.sentence_threshold, config.digits
    statements = [
        f"""SELECT {BOTH}, word_idx_{side}, min({count}) AS n, min(distance) AS d FROM __THIS__
            GROUP BY {BOTH}, word_idx_{side}""",
        f"""SELECT {BOTH}, round((sum(d) + {c}D * (min(n) - count(1))) / min(n), {d}) AS avg_sentence_distance
            FROM __THIS__ GROUP BY {BOTH}""",
        f"""SELECT {KEYS}, sent_idx_{side}, min(struct(avg_sentence_distance, abs(sent_idx_x - sent_idx_y) AS gap,
            sent_idx_{other})) AS best FROM __THIS__ GROUP BY {KEYS}, sent_idx_{side}""",
        f"""SELECT {KEYS}, sent_idx_{side},
            CASE WHEN best.avg_sentence_distance < {t}D THEN best.sent_idx_{other} END AS sent_idx_{other},
            CASE WHEN best.avg_sentence_distance < {t}D THEN best.avg_sentence_distance END AS avg_sentence_distance
            FROM __THIS__""",
    ]
    return Pipeline(stages=[SQLTransformer(statement=s) for s in statements])


def score_side(pairs: DataFrame, side: str, config: MatchConfig = MatchConfig()) -> DataFrame:
    # SQL stages learn nothing, so the stages are the fitted model
    return PipelineModel(scoring_pipeline(side, config).getStages()).transform(pairs)
