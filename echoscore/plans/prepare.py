"""Dataset preparation: corpus -> samples -> labels -> noisy and silence plans."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from echoscore.operators.indexing import chunked, sample_index
from echoscore.operators.requests import chunk_prompts, classify_requests
from echoscore.operators.responses import apply_chunk_labels, parse_chunk_labels
from echoscore.functions import responses as R
from echoscore.plans.predict import with_answers, with_remembered_answers


def label_requests(samples: DataFrame) -> DataFrame:
    """Classify request lines for all samples, 50 texts each."""
    return classify_requests(chunk_prompts(chunked(sample_index(samples))))


def labelled_from_lines(samples: DataFrame, lines: DataFrame) -> DataFrame:
    """Samples + medical_yn from response lines (file, seq, raw)."""
    labels = parse_chunk_labels(lines, F.col("file"), F.col("seq"))
    labelled = apply_chunk_labels(chunked(sample_index(samples)), labels)
    return labelled.select(*samples.columns, "medical_yn")


def labelled_by(samples: DataFrame, predict: Callable[[pd.Series], pd.Series], memory: str | None = None) -> DataFrame:
    """Samples + medical_yn with the model called inside the job; with a ``memory`` folder, for prompts that it has not seen yet."""
    indexed = chunked(sample_index(samples))
    prompts = chunk_prompts(indexed)
    answers = with_remembered_answers(prompts, predict, memory) if memory else with_answers(prompts, predict)
    labels = answers.select("chunk_idx", R.boolean_list(F.col("answer")).alias("labels"))
    return apply_chunk_labels(indexed, labels).select(*samples.columns, "medical_yn")
