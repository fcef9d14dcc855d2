"""Secret scans with multipart credential linking.

Base spans are plain patterns per kind (leftmost, not overlapping; matches that are too short are
dropped): ``assign`` (a name such as password, then a value), ``access`` (access identifiers) and
``hex`` (long hexadecimal strings).

A credential often comes in parts: an identifier, a secret, an endpoint. Weak parts alone look
like ordinary text (a 40-character base64 run, a host name, an identifier with a rarer prefix), so
they are reported only where complementary parts lie in the same scope:

* ``weak_secret``: with an identifier (``access`` or ``weak_id``) in scope;
* ``weak_id``: with a secret (``assign``, ``hex`` or ``weak_secret``) in scope;
* ``endpoint``: with an identifier in scope that has a secret in scope, too.

The scope of an identifier reaches ``reach`` characters to either side; an endpoint and a secret
may lie on opposite sides of it. Linking is an interval
join in Spark: scopes are cut into bins of ``reach`` characters, parts carry the bin of their
start, and the join is on (row, bin) with a distance condition. It is a semi join: which part has
a partner, not which pairs there are. A part takes up at least ``SHORTEST`` characters and parts
of one kind do not overlap, so a bin holds a bounded number of parts, however long a text or
frequent a part is.

Edge cases: a null text is an empty one, with no spans. Rows are told apart by a row key made of
partition and place, so repeated rows and null ids each keep their own spans. Overlaps between
kinds are all reported. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadlake.llm.common import Scratch, with_results

#: In this order spans with the same start are listed.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]
LEAST = {"assign": 6, "access": 20, "hex": 24}
REACH = 400
SHORTEST = 8
REDACTED = "[REDACTED]"
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    # A run shorter than the least length cannot match, nor can any later start within it.
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "weak_id": re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    # "=" before the run is an assignment, after it padding.
    "weak_secret": re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    "endpoint": re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.amazonaws\.com\b"),
}
SPAN = "struct<kind: string, start: bigint, `end`: bigint>"


def spans_in(text: str) -> list[tuple[str, int, int]]:
    """All spans of the text, weak ones included, by kind."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            if kind == "assign" and len(m[2]) < LEAST[kind]:
                continue
            if kind == "weak_secret" and not (re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def _scan(names: list[str]):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def emit(batches):
        for batch in batches:
            base, weak, digests = [], [], []
            for text in batch.column("text").to_pylist():
                found = spans_in(text or "")
                own = sorted((x for x in found if x[0] in BASE), key=lambda x: (x[1], KINDS.index(x[0])))
                base.append([dict(zip(("kind", "start", "end"), x)) for x in own])
                weak.append([dict(zip(("kind", "start", "end"), x)) for x in found if x[0] not in BASE])
                digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest())
            columns = [*(batch.column(n) for n in names), pa.array(base, span), pa.array(weak, span), pa.array(digests)]
            yield pa.record_batch(columns, [*names, "base", "weak", "base_sha256"])
    return emit


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of ``parts`` (row, kind, start, end; all kinds) the weak ones with complementary parts in
    scope."""
    ids = parts.where(F.col("kind").isin("access", "weak_id"))
    secrets = parts.where(F.col("kind").isin("assign", "hex", "weak_secret"))
    endpoints = parts.where(F.col("kind") == "endpoint")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Parts of left with a gap of ``reach`` at most to a part of right."""
        bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
        own = left.withColumn("bin", bins(F.col("start"), F.col("end")))
        s, e = F.col("start") - reach, F.col("end") + reach
        around = right.select(F.col("row").alias("r"), s.alias("s"), e.alias("e"), bins(s, e).alias("b"))
        meets = (F.col("start") <= F.col("e")) & (F.col("end") >= F.col("s"))
        own = own.join(around, (F.col("row") == F.col("r")) & (F.col("bin") == F.col("b")) & meets, "left_semi")
        return own.drop("bin").distinct()

    lone_ids, lone_secrets = ids.where("kind = 'weak_id'"), secrets.where("kind = 'weak_secret'")
    out = near(lone_ids, secrets).unionByName(near(lone_secrets, ids))
    return out.unionByName(near(endpoints, near(ids, secrets))).select("row", "kind", "start", "end")


def scanned(docs: DataFrame, *, text_col: str = "text", reach: int = REACH, with_text: bool = True) -> DataFrame:
    """The input columns with ``base`` and ``spans`` (arrays of kind, start, end; in order of
    start, then kind) and base_sha256 (over kind:start:end of the base spans)."""
    scratch = Scratch(docs.sparkSession, "secrets")
    results = ["base", "spans", "base_sha256"]
    keep = [c for c in with_results(docs, results) if with_text or c != text_col]
    names = [f"_{i}" for i in range(len(keep))]
    wide = docs.select(F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names) if c != text_col))
    names = ["text" if c == text_col else n for c, n in zip(keep, names)]
    ddl = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names)]
    found = wide.mapInArrow(_scan(names), ", ".join([*ddl, f"base array<{SPAN}>", f"weak array<{SPAN}>", "base_sha256 string"]))
    back = [F.col(n).alias(c) for c, n in zip(keep, names)]
    # The row key is fixed by writing the rows: later steps read the same keys.
    found = scratch.write(found.withColumn("row", F.monotonically_increasing_id()), "found")
    parts = found.where("size(weak) > 0").select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.kind", "p.start", "p.end")
    weak = scratch.write(linked(parts, reach), "weak")
    weak = weak.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    out = found.join(weak.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    spans = ordered(F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as array<{SPAN}>)"))))
    return out.select(*back, "base", spans.alias("spans"), "base_sha256")


def ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redacted(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The input rows with each span replaced by ``REDACTED`` (touching or overlapping spans by
    one); rows without spans are as they were."""
    columns = docs.columns
    out = scanned(docs, text_col=text_col, **options)
    has = F.size("spans") > 0
    text = F.when(has, _masked(F.when(has, F.col(text_col)), F.when(has, F.col("spans")))).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*(F.col(f"`{c}`") for c in columns if c.lower() not in ("base", "spans", "base_sha256")))


def masked(text: str, spans) -> str:
    """``spans`` (start, end), in order of start. One pass over the text."""
    out, at, covered = [], 0, -1
    for start, end in spans:
        if start > covered:  # neither touching nor overlapping what is masked
            out += [text[at:start], REDACTED]
        at = covered = max(covered, end)
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else masked(t, [(x["start"], x["end"]) for x in own]) for t, own in zip(texts, spans)], dtype=object)
