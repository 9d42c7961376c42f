"""Votes of several judges as a relation: one row for each target and model, failures as rows of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as T

#: What a judge is asked with: model, context, number of the attempt from 1.
Judge = Callable[[str, str, int], str]


def judge_votes(targets: DataFrame, models: list[str], judge: Judge, attempts: int = 3, default: float = 5.0, context: str = "context") -> DataFrame:
    """``targets`` x ``models`` with (model, pos, score, reply, attempts, error), asked in Arrow batches where the targets lie.

    A judge that raises is asked again, up to ``attempts`` times; then the row has the error and no score. A reply
    without a number counts as ``default``; statistics over the scores leave out the error rows. A null context is asked as an empty one. No models: no rows.
    """

    @F.pandas_udf("reply string, attempts int, error string")
    def asked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def ask(model: str, text: str) -> tuple:
            error = None
            for attempt in range(1, attempts + 1):
                try:
                    return judge(model, text, attempt), attempt, None
                except Exception as found:  # whatever a judge raises is a result of its row
                    error = f"{type(found).__name__}: {found}"
            return None, attempts, error

        for names, texts in batches:
            yield pd.DataFrame([ask(m, t or "") for m, t in zip(names, texts, strict=True)], columns=["reply", "attempts", "error"])

    named = F.array(*[F.lit(m) for m in models]).cast("array<string>")
    rows = targets.select("*", F.posexplode(named).alias("pos", "model")).withColumn("_a", asked("model", F.col(context)))
    score = F.when(F.col("_a.error").isNull(), T.reply_score(F.coalesce("_a.reply", F.lit("")), default=default))
    return rows.select(*targets.columns, "model", "pos", score.alias("score"), "_a.reply", "_a.attempts", "_a.error")
