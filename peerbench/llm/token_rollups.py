"""Token counts by delta-maintained rollups.

Totals by source, language and tokenizer version are sums of what each batch of changes added, and
nothing is counted twice. A change names the counts before and after it: an insert has none before, a
delete none after, a revision both. A batch is aggregated (within tasks first, so a hot source costs
no more than any) and written under its id; it counts once its write is complete, and a batch with
the same id is not applied again.

Defined results: null source, language or version is a group of its own; a change with neither count
adds nothing; repeated rows are separate changes; an empty batch is committed and adds nothing. Groups
whose totals are back at zero are not returned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
_SCHEMA = "source string, lang string, version string, n_docs bigint, n_tokens bigint"


class TokenRollups:
    """The batches in one folder. One writer at a time; readers see whole batches only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _complete(self, folder: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"a batch id is made of letters, digits, dots and dashes, not {batch!r}")
        return f"{self.path}/batches/{batch}"

    def committed(self) -> list[str]:
        """Ids of all batches that count."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if self._complete(f"{self.path}/batches/{n}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (source, lang, version, before, after and, if rows stand for several, times) under the id ``batch``; False if a
        batch with this id has been applied. What a failed write has left behind is overwritten."""
        folder = self._folder(batch)
        if self._complete(folder):
            return False
        signed = changes.select(
            *[F.col(k).cast("string").alias(k) for k in KEYS],
            (F.col("after").isNotNull().cast("int") - F.col("before").isNotNull().cast("int")).alias("docs"),
            (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).cast("long").alias("tokens"),
            (F.col("times") if "times" in changes.columns else F.lit(1)).cast("long").alias("times"),
        ).select(*KEYS, (F.col("docs") * F.col("times")).alias("docs"), (F.col("tokens") * F.col("times")).alias("tokens"))
        delta = signed.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        delta.write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens of each group over all committed batches."""
        folders = [self._folder(b) for b in self.committed()]
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*folders)
        rows = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return rows.where("n_docs <> 0 or n_tokens <> 0")


def _kept(counts: DataFrame) -> list[str]:
    return [*KEYS, *(["times"] if "times" in counts.columns else [])]


def inserted(counts: DataFrame) -> DataFrame:
    """Changes for documents that are new: ``counts`` has source, lang, version and n_tokens, and may have times."""
    return counts.select(*_kept(counts), F.lit(None).cast("long").alias("before"), F.col("n_tokens").alias("after"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*_kept(counts), F.col("n_tokens").alias("before"), F.lit(None).cast("long").alias("after"))


def revised(counts: DataFrame) -> DataFrame:
    """Changes for documents counted anew: ``n_tokens`` before, ``new_tokens`` now."""
    return counts.select(*_kept(counts), F.col("n_tokens").alias("before"), F.col("new_tokens").alias("after"))
