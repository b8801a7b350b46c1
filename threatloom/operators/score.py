"""Answers of a text model, from a callable or from a stored table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.session import run_dir, stored
from threatloom.sources.collection import Collection

Responder = Callable[[str], str]
#: Answers to a list of prompts, in their order; an answer may be an exception.
BatchResponder = Callable[[Sequence[str]], Sequence["str | Exception | None"]]

PROMPTS_PER_CALL = 32
#: Prompts whose answers are kept together; as many may be asked again after a run has broken off.
WAVE_PROMPTS = 200_000
#: Slices in which the prompts of a wave are compared with those that have an answer.
_SLICES = 8
ERROR_CHARS = 500


def one_by_one(ask: Responder) -> BatchResponder:
    """A responder of single prompts as one of lists: a failed call fails alone."""

    def answer(prompts: Sequence[str]) -> list[str | Exception | None]:
        out: list[str | Exception | None] = []
        for prompt in prompts:
            try:
                out.append(ask(prompt))
            except Exception as error:  # noqa: BLE001 - reported in the row's error column
                out.append(error)
        return out

    return answer


def score_text(
    df: DataFrame, prompt: str, responder: Callable[[], Responder], out: str = "response", error: str = "response_error"
) -> DataFrame:
    """Add the model's answer to each prompt and, where the model failed, its error, asking prompt by prompt."""
    return score_batches(df, prompt, lambda: one_by_one(responder()), out, error)


def score_batches(
    df: DataFrame, prompt: str, responder: Callable[[], BatchResponder], out: str = "response",
    error: str = "response_error", prompts_per_call: int = PROMPTS_PER_CALL,
) -> DataFrame:
    """As `score_text`, asking about up to `prompts_per_call` prompts at once.

    The factory is called once per task. A call that raises is an error of all its prompts; a null prompt is not asked
    about and has neither answer nor error.
    """
    answer_type = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = responder()
        for batch in batches:
            prompts = batch.to_pylist()
            rows: list[tuple] = [(None, None)] * len(prompts)
            asked = [i for i, text in enumerate(prompts) if text is not None]
            for at in range(0, len(asked), prompts_per_call):
                places = asked[at : at + prompts_per_call]
                try:
                    found = list(ask([prompts[i] for i in places]))
                    if len(found) != len(places):
                        raise ValueError(f"{len(found)} answers to {len(places)} prompts")
                except Exception as failure:  # noqa: BLE001 - reported in the rows' error column
                    found = [failure] * len(places)
                for i, value in zip(places, found):
                    failed = isinstance(value, Exception)
                    rows[i] = (None, f"{type(value).__name__}: {value}"[:ERROR_CHARS]) if failed else (value, None)
            yield pa.StructArray.from_arrays(
                [pa.array([r[n] for r in rows], pa.string()) for n in (0, 1)], names=["answer", "error"]
            )

    scored = df.withColumn("__scored", F.arrow_udf(answers, answer_type)(F.col(prompt)))
    return scored.withColumns({out: F.col("__scored.answer"), error: F.col("__scored.error")}).drop("__scored")


def answer_collection(spark: SparkSession, root: str, buckets: int = 64) -> Collection:
    """Answers of one model and prompt version, kept by a hash of the prompt."""
    schema = T.StructType([T.StructField("prompt_id", T.StringType()), T.StructField("response", T.StringType())])
    return Collection(spark, root, schema, key="prompt_id", buckets=buckets)


def score_open(
    df: DataFrame, prompt: str, responder: Callable[[], BatchResponder], answers: Collection, out: str = "response",
    error: str = "response_error", prompts_per_call: int = PROMPTS_PER_CALL, wave_prompts: int = WAVE_PROMPTS,
) -> DataFrame:
    """As `score_batches`, asking only about distinct prompts that have no answer yet.

    Prompts are asked in waves, and the answers of each are kept before the next begins, so that a run that breaks off or
    is repeated asks about what is left. Failures are not kept: they are errors of this run, and asked again by the next.
    """
    spark = df.sparkSession
    answers.create()
    keyed = stored(df.withColumn("prompt_id", F.sha2(F.col(prompt).cast("string"), 256)), "prompts")
    asked = keyed.where(F.col(prompt).isNotNull()).select("prompt_id", F.col(prompt).cast("string").alias("prompt"))
    still_open = _open_prompts(asked, answers.read().select("prompt_id"), wave_prompts)
    counts = {r.part: r["count"] for r in still_open.groupBy("part").count().collect()}
    failed = run_dir(spark, "failed")
    for parts in _waves(counts, wave_prompts):
        some = still_open.where(F.col("part").isin(parts)).select("prompt_id", "prompt")
        scored = stored(
            score_batches(some, "prompt", responder, "response", "error", prompts_per_call).drop("prompt"), "wave"
        )
        # no prompt of a wave has an answer yet
        answers.insert(scored.where("error IS NULL").select("prompt_id", "response"))
        scored.where("error IS NOT NULL").select("prompt_id", "error").write.mode("append").parquet(failed)
    error_schema = "prompt_id string, error string"
    errors = spark.read.schema(error_schema).parquet(failed) if counts else spark.createDataFrame([], error_schema)
    errors = errors.withColumnRenamed("error", error)
    found = answers.read().select("prompt_id", F.col("response").alias(out))
    joined = keyed.drop(*[c for c in (out, error) if c in df.columns]).join(found, "prompt_id", "left")
    return joined.join(errors, "prompt_id", "left").drop("prompt_id")


def _open_prompts(asked: DataFrame, held: DataFrame, wave_prompts: int) -> DataFrame:
    """Distinct prompts without an answer, stored in one folder for each part, of at most about a wave."""
    parts = max(1, -(-asked.count() // wave_prompts))
    hashed = F.xxhash64("prompt_id")
    rows = asked.withColumn("held", F.lit(False)).unionByName(
        held.withColumns({"prompt": F.lit(None).cast("string"), "held": F.lit(True)})
    ).withColumns({
        "part": F.pmod(hashed, F.lit(parts)).cast("int"),
        "slice": F.pmod(F.shiftright(hashed, 32), F.lit(_SLICES)).cast("int"),
    })
    # one shuffle serves the comparison and the folders
    dealt = rows.repartition(parts * _SLICES, "part", "slice")
    each = dealt.groupBy("part", "slice", "prompt_id").agg(
        F.first("prompt", ignorenulls=True).alias("prompt"), F.bool_or("held").alias("held")
    )
    path = run_dir(asked.sparkSession, "open-prompts")
    fresh = each.where("NOT held").select("prompt_id", "prompt", "part")
    fresh.write.option("compression", "zstd").partitionBy("part").parquet(path)
    return asked.sparkSession.read.schema(fresh.schema).parquet(path)


def _waves(counts: dict[int, int], prompts: int) -> Iterator[list[int]]:
    """Parts put together up to a number of prompts."""
    held, size = [], 0
    for part, count in sorted(counts.items()):
        if held and size + count > prompts:
            yield held
            held, size = [], 0
        held.append(part)
        size += count
    if held:
        yield held


def join_responses(df: DataFrame, responses: DataFrame, on: Sequence[str], out: str = "response") -> DataFrame:
    """Add stored answers by key; null where there is none."""
    stored = responses.select(*on, F.col("response").alias(out))
    return df.join(stored, list(on), "left")
