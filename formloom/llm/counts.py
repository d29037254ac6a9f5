"""Token counts kept by signed deltas.

A batch of changes becomes additive deltas per (source, language, tokenizer version):
an insert adds a document and its tokens, a delete takes them away, a revision adds
the difference of its two counts.  Deltas are summed before anything is shuffled by
key, so a source with a third of all rows is no hot task.

A store is a folder with one sub-folder per batch id.  A batch is written beside it
and renamed into place by a rename that fails where the place is taken, so of several
committers of a batch id one succeeds, and a commit may be repeated after a failure.  On
HDFS that rename is atomic; a store on an object store needs one committer at a time.
``compact`` sums what was committed into a new base, which remembers the ids it covers.
Totals are the sum of the base and the batches after it, at every level of (source,
language, tokenizer version).

Defined results for odd input: a null source, language or version is a key of its
own, told from the total of its level by ``level``; null counts are 0; an unknown
change kind raises; repeated rows count again, as the changes are a log; an empty
batch commits as empty; other columns are ignored.  A commit runs a job.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def deltas(changes: DataFrame) -> DataFrame:
    """Additive deltas of ``changes(kind, source, lang, tokenizer, n_tokens, old_tokens)``; a column ``times`` says how often a change counts."""
    times = F.col("times").cast("long") if "times" in changes.columns else F.lit(1).cast("long")
    n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    kind = F.col("kind")
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("long")
    return changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(
        F.sum(times * F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong)).cast("long").alias("n_docs"),
        F.sum(times * F.when(kind == "insert", n).when(kind == "delete", -n).when(kind == "revise", n - old)).cast("long").alias("n_tokens"),
    )


class Rollup:
    """The committed batches of one store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _names(self, lead: str) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(n[len(lead) :] for n in names if n.startswith(lead))

    def _base(self) -> str | None:
        """The folder of the latest base."""
        bases = self._names("base=")
        return f"{self.path}/base={bases[-1]}" if bases else None

    def _covered(self) -> set[str]:
        base = self._base()
        return {r["id"] for r in self.spark.read.schema("id string").parquet(f"{base}/ids").collect()} if base else set()  # ids of batches only

    def committed(self) -> list[str]:
        return sorted(self._covered() | set(self._names("batch=")))

    def _move(self, draft: str, final: str) -> bool:
        """Renames a folder to a place that must be free; False if it is taken."""
        sc = self.spark.sparkContext
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(final).toUri(), sc._jsc.hadoopConfiguration())
        no_options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(draft), self._path(final), no_options)
            return True
        except Py4JJavaError:
            if not self._fs.exists(self._path(final)):
                raise
            self._fs.delete(self._path(draft), True)
            return False

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it had been applied before."""
        final = f"{self.path}/batch={batch_id}"
        if self._fs.exists(self._path(final)) or batch_id in self._covered():
            return False
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(draft)
        return self._move(draft, final)

    def compact(self) -> bool:
        """Sums all committed batches into a new base and removes them; False if another did so first."""
        ids, old, fresh = self.committed(), self._base(), self._names("batch=")
        place = f"{int(old.rsplit('=', 1)[1]) + 1 if old else 0:09d}"
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        self._rows().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{draft}/data")
        self.spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.parquet(f"{draft}/ids")
        if not self._move(draft, f"{self.path}/base={place}"):
            return False
        for name in [f"batch={i}" for i in fresh] + ([old.rsplit("/", 1)[1]] if old else []):  # what the new base covers is no longer read
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return True

    def _rows(self) -> DataFrame:
        """Deltas of the base and of the batches that it does not cover."""
        base, covered = self._base(), self._covered()
        paths = [f"{self.path}/batch={b}" for b in self._names("batch=") if b not in covered] + ([f"{base}/data"] if base else [])
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        """Sums over all committed batches for every level of the keys."""
        base = self._rows().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return (
            base.rollup(*KEYS)
            .agg(
                F.grouping_id().alias("g"),
                F.sum("n_docs").alias("n_docs"),
                F.sum("n_tokens").alias("n_tokens"),
            )
            .select(
                F.when(F.col("g") == 0, 3).when(F.col("g") == 1, 2).when(F.col("g") == 3, 1).otherwise(0).alias("level"),
                *KEYS,
                F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"),
                F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"),
            )
        )
