"""The model step: a text-to-text callable applied to a prompt column.

Runs in ``mapInPandas`` (Arrow batches, one model client per task); a row
whose call fails gets its error text in ``model_error`` instead of failing
the task. The output is nondeterministic by nature: callers write it as a
table (``session.materialize``) before using it more than once, so a retried or
recomputed stage never calls the model again.

:func:`answered` keeps what the model said in a store of answers keyed by the
prompt's SHA-256: a prompt is called once however many rows or runs ask it, and
a run that was broken off goes on where it stopped.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroll.sources.files import folder_exists

ModelFactory = Callable[[], Callable[[str], str]]


def apply_model(df: DataFrame, prompt_col: str, model_factory: ModelFactory,
                out_col: str = "response", error_col: str = "model_error") -> DataFrame:
    schema = T.StructType(list(df.schema.fields) + [
        T.StructField(out_col, T.StringType()), T.StructField(error_col, T.StringType())])

    def run(batches):
        model = model_factory()
        for pdf in batches:
            responses, errors = [], []
            for prompt in pdf[prompt_col].tolist():
                try:
                    responses.append(model(prompt))
                    errors.append(None)
                except Exception as e:  # recorded per row, the batch goes on
                    responses.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{out_col: responses, error_col: errors})

    return df.mapInPandas(run, schema)


ANSWERS = "prompt_sha string, response string, model_error string, attempt int"


def read_answers(spark: SparkSession, store: str) -> DataFrame:
    """One row per prompt asked so far: its answer, else the error of the last attempt."""
    if not folder_exists(spark, store):
        return spark.createDataFrame([], ANSWERS)
    rows = spark.read.schema(ANSWERS).option("recursiveFileLookup", True).parquet(store)
    best = F.max_by(F.struct("response", "model_error"), F.struct(F.col("response").isNotNull(), "attempt", "response"))
    return (rows.groupBy("prompt_sha").agg(best.alias("b"), F.max("attempt").alias("attempt"))
                .select("prompt_sha", "b.response", "b.model_error", "attempt"))


def answered(df: DataFrame, prompt_col: str, model_factory: ModelFactory, store: str, attempts: int = 3, parallel: int = 4,
             tasks: int | None = None, out_col: str = "response", error_col: str = "model_error") -> DataFrame:
    """Rows with the answer to their prompt (or the error of the last attempt)
    and how many ``attempt`` were made in all runs.

    Only prompts the store has no answer to are called, each once, in ``tasks``
    tasks of ``parallel`` calls at a time; a call that fails is repeated up to
    ``attempts`` times. New answers are written to the store before they are
    used. A null prompt is not asked.
    """
    spark = df.sparkSession
    known = read_answers(spark, store)
    asked = df.withColumn("_sha", F.sha2(F.col(prompt_col), 256))
    distinct = asked.where(F.col("_sha").isNotNull()).groupBy("_sha").agg(F.first(prompt_col).alias("prompt"))
    todo = (distinct.join(known.select(F.col("prompt_sha").alias("_sha"), F.col("response").isNotNull().alias("_known"),
                                       F.col("attempt").alias("tried")), "_sha", "left")
                    .where(~F.coalesce("_known", F.lit(False)))
                    .select(F.col("_sha").alias("prompt_sha"), "prompt", F.coalesce("tried", F.lit(0)).alias("tried")))

    def run(batches):
        model = model_factory()

        def call(prompt, tried):
            for k in range(1, attempts + 1):
                try:
                    return model(prompt), None, tried + k
                except Exception as e:  # recorded per prompt, the others go on
                    error = f"{type(e).__name__}: {e}"
            return None, error, tried + attempts

        with ThreadPoolExecutor(parallel) as pool:
            for pdf in batches:
                said = list(pool.map(call, pdf["prompt"].tolist(), pdf["tried"].tolist()))
                out = pdf[["prompt_sha"]].copy()
                for i, name in enumerate(("response", "model_error", "attempt")):
                    out[name] = [s[i] for s in said]
                yield out

    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo.repartition(n, "prompt_sha").mapInPandas(run, ANSWERS).write.parquet(f"{store}/run={uuid.uuid4().hex}")
    answers = read_answers(spark, store).toDF("_sha", out_col, error_col, "attempt")
    joined = asked.join(answers, "_sha", "left").drop("_sha")
    return joined.withColumn(error_col, F.when(F.col(prompt_col).isNull(), F.lit("no prompt")).otherwise(F.col(error_col)))


# --- deterministic stand-in used by tests and the registered jobs ------------------

_DATE_LINE = re.compile(r"^Day: (\S+)$", re.M)
_URL_LINE = re.compile(r"^URL: (.*)$", re.M)


def organize_stub() -> Callable[[str], str]:
    """A model stand-in for the organise prompt: one story per article of the
    prompt (url copied), a fenced JSON answer; an article whose page could not
    be fetched yields a story without English facts (which fails validation).
    """
    def call(prompt: str) -> str:
        m = _DATE_LINE.search(prompt)
        date = m.group(1) if m else ""
        start = prompt.find("<<< articles\n")
        end = prompt.rfind("\n>>> articles")
        body = prompt[start + len("<<< articles\n"): end if end >= 0 else None]
        stories = []
        for block in body.split("\n\n---\n\n"):
            u = _URL_LINE.search(block)
            if not u:
                continue
            url = u.group(1)
            failed = "[Could not fetch full article body:" in block
            stories.append({
                "icon": "📰", "status": "NEW", "tags": ["NEWS", "WEB" if url.startswith("http") else "LOCAL"],
                "title": {"ko": "기사 " + url, "en": "Article " + url},
                "facts": {"ko": ["본문 " + str(len(block))], "en": [] if failed else ["Body " + str(len(block))]},
                "interp": {"ko": "요약", "en": "Summary"},
                "url": url,
            })
        doc = {"headline": {"ko": date + " 소식", "en": "News of " + date}, "stories": stories,
               "injuries": [], "moves": [], "schedule": []}
        return "```json\n" + json.dumps(doc, ensure_ascii=False) + "\n```"
    return call
