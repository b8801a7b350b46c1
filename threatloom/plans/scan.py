"""Scan: source files to enriched findings."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.constants import MATCHES_PER_FINDING
from threatloom.functions.templates import prompt
from threatloom.operators.embed import Encoder, hashed_tokens
from threatloom.operators.enrich import attach_matches
from threatloom.operators.extract import all_functions
from threatloom.operators.findings import findings_of
from threatloom.operators.score import BatchResponder, join_responses, score_open
from threatloom.session import stored
from threatloom.sources.collection import Collection


def prompts(files: DataFrame) -> DataFrame:
    """Functions of the files (file_path, text) with the prompt of each."""
    return all_functions(files).withColumn("prompt", prompt(F.col("code")))


def scan_with_model(
    files: DataFrame, responder: Callable[[], BatchResponder], threats: DataFrame, answers: Collection,
    *, k: int = MATCHES_PER_FINDING, encoder: Callable[[], Encoder] = hashed_tokens, failures: str = "report",
) -> DataFrame:
    """Findings with their nearest threats, asking a text model about each function.

    Answers are kept in `answers` (see `answer_collection`), so that no code is asked about twice, in this scan or another;
    `one_by_one` makes a responder of one that takes single prompts. Functions about which the model failed are counted in a
    warning or, with `failures="raise"`, end the scan; the next scan asks about them again.
    """
    answered = stored(score_open(prompts(files), "prompt", responder, answers).drop("prompt"), "answers")
    failed = answered.where(F.col("response_error").isNotNull())
    if example := failed.select("response_error").first():
        message = f"the model failed on {failed.count()} functions, for example: {example[0]}"
        if failures == "raise":
            raise RuntimeError(message)
        warnings.warn(message, stacklevel=2)
    return attach_matches(findings_of(answered), threats, k=k, encoder=encoder)


def scan_with_responses(
    files: DataFrame, responses: DataFrame, threats: DataFrame,
    *, k: int = MATCHES_PER_FINDING, encoder: Callable[[], Encoder] = hashed_tokens,
) -> DataFrame:
    """As `scan_with_model`, with stored answers (file_path, name, start_line, response).

    A name may stand in a file more than once; the line tells its functions apart.
    """
    answered = join_responses(all_functions(files), responses, ["file_path", "name", "start_line"])
    return attach_matches(stored(findings_of(answered), "findings"), threats, k=k, encoder=encoder)
