"""Token counts by source, language and tokenizer version, maintained from deltas.

A batch of changes inserts, deletes or revises documents. Each change becomes signed rows: +1 and
its count for a new state, -1 and the old count for the state it replaces. Sums over signed rows
are additive, so totals never need the corpus again: a batch is reduced to one small delta by
(source, lang, tokenizer), and the totals are the sum of the committed batches' deltas.

Layout under the rollup's folder, by batch: ``change/<batch>`` (the changes as they came) and
``log/<batch>`` (signed rows per document) are written first, ``delta/<batch>`` last; Spark's success marker of the delta commits the batch. A batch that
is committed again changes nothing; one that died half-way is written over. The state of a
document is the sum of its signed rows in committed batches.

Edge cases: inserting a document that is there replaces it, as revising does; revising one that is
not there inserts it; deleting one that is not there does nothing. Of several changes to a document
in one batch the one with the largest ``seq`` counts (ties: the largest row), so repeated rows count
once. A row with a null id cannot be found again: it is inserted, each such row for itself, and
never revised or deleted. Null sources and languages are groups of their own. An empty batch is
committed with an empty delta. A hot source is one group of a partial aggregate.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.common import ship

KEYS = ["source", "lang", "tokenizer"]
CHANGE = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, op string, seq bigint"
LOG = "doc_id bigint, tokenizer string, source string, lang string, sign int, n_tokens bigint"
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
_ENCODERS: dict = {}


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/delta/*/_SUCCESS")
        states = found.getFileSystem(conf).globStatus(found) or []
        return sorted(s.getPath().getParent().getName() for s in states)

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{b}" for b in self._committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self, of: DataFrame | None = None) -> DataFrame:
        """One row for each document and tokenizer version that is there (``of``: of those only,
        picked from the log before it is grouped)."""
        log = self._read("log", LOG).where("doc_id is not null")
        if of is not None:
            log = log.join(of.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        own = log.groupBy("doc_id", *KEYS)
        return own.agg(F.sum("sign").alias("live"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).where("live > 0").drop("live")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been committed before."""
        if batch in self._committed():
            return False
        # Written first: counting the tokens is the costly part, and the changes are read thrice.
        changes.select("doc_id", "tokenizer", "source", "lang", "n_tokens", "op", "seq").write.mode("overwrite").parquet(f"{self.path}/change/{batch}")
        change = self.spark.read.schema(CHANGE).parquet(f"{self.path}/change/{batch}")
        latest = change.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("new"))
        latest = latest.select("doc_id", "tokenizer", "new.op", "new.source", "new.lang", "new.n_tokens")
        old = self.state(latest)
        added = latest.where("op <> 'delete'").unionByName(change.where("doc_id is null and op <> 'delete'").drop("seq"))
        columns = ["doc_id", "tokenizer", "source", "lang", "sign", "n_tokens"]
        signed = added.withColumn("sign", F.lit(1)).select(columns).unionByName(old.withColumn("sign", F.lit(-1)).select(columns))
        signed.write.mode("overwrite").parquet(f"{self.path}/log/{batch}")
        written = self.spark.read.schema(LOG).parquet(f"{self.path}/log/{batch}")
        delta = written.groupBy(KEYS).agg(F.sum(F.col("sign").cast("bigint")).alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/delta/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of what is there."""
        out = self._read("delta", DELTA).groupBy(KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs > 0")


def _encoder(path: str, pattern: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def counted(docs: DataFrame, ranks: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, n_tokens): tokens of whole texts by a rank file; null texts have none."""
    def emit(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            n = [len(encoder.encode_ordinary(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.col(text_col).alias("text"))
    return rows.mapInArrow(emit, "doc_id bigint, source string, lang string, n_tokens bigint")
