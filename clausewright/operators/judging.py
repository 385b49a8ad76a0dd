"""A judge that is asked once for each distinct question, ever.

Questions are pairs of an assertion and the evidence heard on it, known by the digest of both. What was
answered before is looked up in a table of digests; of the rest each distinct pair goes to the judge
once, however many findings ask it, and its answer is added to the table. Verdicts come back by a join
on the digest, which brings no text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import stored

SCHEMA = "digest binary, verdict string"


def digest(assertion: Column, evidence: Column) -> Column:
    """Of the lengths and texts of both, so that no two pairs are written alike."""
    text = F.concat_ws(":", F.length(assertion).cast("string"), assertion, evidence)
    return F.unhex(F.sha2(text.cast("binary"), 256))


class JudgeMemo:
    """``path`` is a folder that all executors share; answers stay in it between runs.

    Answers are written when all open questions of a run have been asked. A task that is lost is run
    again, and then asks its questions again: no answer is written twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            spark.createDataFrame([], SCHEMA).write.parquet(self.path)

    def answers(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def ask(self, questions: DataFrame, judge: Callable[[str, str], str]) -> None:
        """Puts each distinct question that has no answer to the judge. ``questions``: digest, assertion, evidence."""
        one = questions.groupBy("digest").agg(F.min(F.struct("assertion", "evidence")).alias("q"))
        new = one.join(self.answers().select("digest"), "digest", "left_anti").select("digest", "q.assertion", "q.evidence")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                given = [judge(a, e) or "n/a" for a, e in zip(part["assertion"], part["evidence"], strict=True)]
                yield pd.DataFrame({"digest": part["digest"], "verdict": [v if v in ("pass", "fail") else "needs_human" for v in given]})

        stored(new.mapInPandas(run, SCHEMA), "answers").write.mode("append").parquet(self.path)

    def judged(self, found: DataFrame, judge: Callable[[str, str], str]) -> DataFrame:
        """``found`` with a column ``judged``. It has assertion, heard and judge_asked; only rows that ask get a verdict."""
        asks = F.col("judge_asked") & F.col("assertion").isNotNull()
        found = stored(found.withColumn("__question", F.when(asks, digest(F.col("assertion"), F.coalesce("heard", F.lit(""))))), "found")
        self.ask(found.filter(F.col("__question").isNotNull()).select(F.col("__question").alias("digest"), "assertion", F.coalesce("heard", F.lit("")).alias("evidence")), judge)
        told = self.answers().groupBy("digest").agg(F.min("verdict").alias("judged"))
        return found.join(told, F.col("__question") == F.col("digest"), "left").drop("digest", "__question")
