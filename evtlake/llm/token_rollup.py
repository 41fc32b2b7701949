"""Token counts kept up to date by signed deltas.

A batch of changes says for each document and tokenizer version: ``insert`` a count, ``revise``
it, or ``delete`` the document. A batch is reduced to one change per document and version and turned
into signed rows: an insert adds the new count, a delete takes off the count on record, a revision
does both. The rows of a batch are
written as one ledger partition and its additive totals by source, language and tokenizer
version as one rollup partition; the totals of all committed batches add up to the truth.

A commit is one new file whose name is the batch id. Spark overwrites a batch's folders as a
whole, so a batch that failed half way is simply run again, and one that is committed is not
applied a second time.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id string, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class Rollup:
    """Ledger, totals and commits below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _file(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def committed(self) -> list[str]:
        """Ids of committed batches; one file each."""
        fs, path = self._file("commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{batch}" for batch in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens of all committed batches; groups that have come to nothing are left out."""
        return self._read("totals", TOTALS).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where(
            (F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def on_record(self) -> DataFrame:
        """What the ledger holds now, one row per document, source, language and tokenizer."""
        return self.ledger().groupBy("doc_id", *KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def signed(self, changes: DataFrame) -> DataFrame:
        """Signed ledger rows of ``changes`` (op, doc_id, source, lang, tokenizer, n_tokens).

        What is on record of a changed document and tokenizer is taken off, and a count that is inserted or
        revised is put on: an insert of what is on record revises it, and a revision of what is not inserts it.
        """
        changes = reduced(changes)
        # a delete without a tokenizer is one of the whole document
        gone = changes.where("op = 'delete' and tokenizer is null").select(F.col("doc_id").alias("_id"))
        whole = F.col("doc_id").eqNullSafe(F.col("_id"))
        single = changes.where("op <> 'delete' or tokenizer is not null").join(gone, whole, "left_anti")
        new = single.where("op in ('insert', 'revise')").select(
            "doc_id", *KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        touched = single.select(F.col("doc_id").alias("_id"), F.col("tokenizer").alias("_tokenizer"))
        record = self.on_record()
        old = record.join(touched, whole & F.col("tokenizer").eqNullSafe(F.col("_tokenizer")), "left_semi").unionByName(record.join(gone, whole, "left_semi"))
        return new.unionByName(old.select("doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False when it is committed already.

        The counts taken off are those on record when the batch began: if another batch has been
        committed since, this one is refused with a RuntimeError and can be run again.
        """
        before = self.committed()
        if batch in before:
            return False
        rows = self.signed(changes.withColumn("doc_id", F.col("doc_id").cast("string")))
        rows.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        written = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{batch}")
        totals = written.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        if self.committed() != before:
            raise RuntimeError(f"batch {batch} was read before another one was committed; run it again")
        fs, path = self._file(f"commits/{batch}")
        fs.create(path, False).close()
        return True


def reduced(changes: DataFrame) -> DataFrame:
    """One change per document and tokenizer: of several, a delete wins over a revision and that over an insert, then the larger count, source and language."""
    rank = F.when(F.col("op") == "delete", 3).when(F.col("op") == "revise", 2).otherwise(1)
    own = F.struct("op", "source", "lang", "n_tokens")
    last = F.max_by(own, F.struct(rank.alias("rank"), F.coalesce("n_tokens", F.lit(0)).alias("n"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang")))
    return changes.where("op in ('insert', 'revise', 'delete')").groupBy("doc_id", "tokenizer").agg(last.alias("_c")).select("doc_id", "tokenizer", "_c.*")


def counted(docs: DataFrame, versions: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and tokenizer version with its count; a version is a pattern whose matches are tokens.

    NULL and empty texts count no tokens. Counting is one pass for all versions.
    """
    counts = [F.struct(F.lit(name).alias("tokenizer"), F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(pattern)).cast("long").alias("n_tokens"))
              for name, pattern in versions.items()]
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), "source", "lang", F.inline(F.array(*counts)))
