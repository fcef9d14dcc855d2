"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the hashes of the text's word
shingles. Two fingerprints link if they differ in at most ``max_distance`` (up to 2) bits.

Search. The bits are cut into three segments of 22, 21 and 21. With two errors at most, there is
always a cyclic pair of segments (e, f) such that e is equal and f differs in one bit at most:
errors (2,0,0) and (1,0,1) leave segment 2 whole with at most one error in segment 3, and so on
around. Segment f is read as a word of the binary Golay code [23, 12]: the code is perfect, so a
word lies within 3 bits of exactly one codeword. A word at 3 bits from its codeword lies at 4
bits from five others. Taking the nearest codeword, and for words at distance 3 those five too,
two words that differ in one bit always share a codeword: if either is within 2 bits of a
codeword then the other is within 3 of the same, else each one's own codeword is within 4 bits of
the other. So a key is (pair, e whole, 12-bit codeword index of f): 5.3 keys for each pair, 16
for each distinct fingerprint. Fingerprints that share a key are compared bit by bit.

A key that more than ``HOT`` distinct fingerprints share is refined: the third segment, which the
key leaves open, has at most two errors, so of its three parts one is equal; the part's number
and value join the key.

Copies collapse into their fingerprint before any of this. A fingerprint has at most 2,080
others within two bits, so links grow in proportion to distinct fingerprints.

Edge cases: a null or empty text, or one without words, has fingerprint zero and links like any
other. Fewer words than a shingle: the whole sequence is the one shingle. Rows with equal ids are
separate rows. A row with a null id links like others but names no component; where a component
has only null ids, component_id is null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from threadlake.llm.common import Scratch, ship, with_results
from threadlake.llm.components import components

RESULTS = ["fingerprint", "component_id"]
SEED = 42
HOT = 500
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRS = ((0, 1), (1, 2), (2, 0))  # whole segment, decoded segment
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 divides x^23 + 1


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1 == 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def golay_errors() -> np.ndarray:
    """By syndrome, the error patterns that lead to the codewords of a word: the one of weight
    3 or less, and where it has weight 3 the five of weight 4; -1 fills up."""
    out = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    light = np.zeros(2048, bool)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for pattern, s in zip(patterns.tolist(), _syndromes(patterns).tolist()):
            if weight < 4 or not light[s]:
                out[s, used[s]] = pattern
                used[s] += 1
                light[s] |= weight < 3
    return out


_ERRORS: list[np.ndarray] = []


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) for each key of the words (up to 23 bits)."""
    if not _ERRORS:
        _ERRORS.append(golay_errors())
    errors = _ERRORS[0][_syndromes(words)]
    row, col = np.nonzero(errors >= 0)
    return row, (words[row].astype(np.int64) ^ errors[row, col]) >> 11


def fingerprint_of(text: bytes, shingle: int) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    ones, total, part = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in pieces:
        part.append(digest(piece, SEED))
        if len(part) == 1 << 16:  # bounds the memory for very long texts
            ones, total, part = ones + _ones(part), total + len(part), []
    ones, total = ones + _ones(part), total + len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _fingerprints(shingle: int):
    def emit(batches):
        for batch in batches:
            fp = np.array([fingerprint_of(t or b"", shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc"), pa.array(fp.view(np.int64))], ["doc", "fp"])
    return emit


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc, fp): the fingerprint's bits as a bigint."""
    ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return plain.mapInArrow(_fingerprints(shingle), "doc bigint, fp bigint")


def _keys(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        seg = [((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
        for number, (whole, decoded) in enumerate(PAIRS):
            row, index = golay_keys(seg[decoded])
            key = (number << 34) | (seg[whole][row] << 12) | index
            yield pa.record_batch([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(seg[3 - whole - decoded][row])], ["key", "fp", "open"])


def links(prints: DataFrame, scratch: Scratch, max_distance: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of the distinct fingerprints ``prints`` (fp) that differ in at most
    ``max_distance`` bits; 2 at most."""
    if not 0 <= max_distance <= 2:
        raise ValueError("the keys are complete for distances up to 2")
    keys = prints.mapInArrow(_keys, "key bigint, fp bigint, open bigint")
    shared = scratch.write(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    keys = scratch.write(keys.join(shared, "key"), "keys")
    parts = F.when(F.col("n") <= HOT, F.array(F.lit(-1).cast("bigint"))).otherwise(F.array(*(F.expr(f"{k}L * 256 + (shiftright(open, {7 * k}) & {(1 << 8) - 1 if k == 2 else 127})") for k in range(3))))
    keys = scratch.write(keys.select("key", "fp", F.explode(parts).alias("part")), "parts")
    scratch.drop("shared", "keys")
    one, two = keys.withColumnRenamed("fp", "a"), keys.withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    return one.join(two, ["key", "part"]).where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(id, fp, component_id, label) for each row of ``docs``. ``label`` tells components apart that
    have the same smallest id (where ids repeat)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, id_col, text_col, shingle), "rows")
    prints = scratch.write(rows.groupBy("fp").agg(F.min("doc").alias("lowest")), "prints")
    pairs = scratch.write(links(prints.select("fp"), scratch, max_distance), "links")
    label = scratch.write(components(pairs, scratch), "label").withColumnRenamed("node", "fp")
    members = scratch.write(prints.join(label, "fp"), "members")
    lowest = members.groupBy("label").agg(F.min("lowest").alias("component"))
    named = members.select("fp", "label").join(lowest, "label").select("fp", "label", "component")
    component = F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("lowest"))
    named = scratch.write(prints.join(named, "fp", "left").select("fp", component.alias("component_id"), F.coalesce("label", "fp").alias("label")), "named")
    return rows.join(named, "fp").select(F.col("doc").alias(id_col), "fp", "component_id", "label")


def with_components(docs: DataFrame, **options) -> DataFrame:
    """(id, fingerprint: 16 lowercase hex digits, component_id) for each row."""
    id_col = options.get("id_col", "doc_id")
    out = near_duplicates(docs, **options)
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with the smallest id (where that
    id is on several of its rows, one with the smallest fingerprint). A row stays for its own
    component only, whatever other rows share its id. Rows with a null id stay where no row of
    their component has an id, as no order tells them apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "one-each")
    named = scratch.write(near_duplicates(docs, id_col=id_col, **options).withColumnRenamed(id_col, "__id"), "named")
    first = named.where(F.col("__id") == F.col("component_id")).groupBy("__id", "label").agg(F.min("fp").alias("__fp")).select("__id", "__fp")
    many = scratch.write(named.where("__id is not null").groupBy("__id").count().where("count > 1").select("__id"), "many")
    own = docs[id_col].cast("bigint")
    kept = docs.join(first.join(many, "__id", "left_anti").select("__id").distinct(), own == F.col("__id"), "left_semi")
    if many.limit(1).count():  # which of the rows with one id it is, their fingerprints tell
        several = with_fingerprint(docs.join(many, own == F.col("__id"), "left_semi"), **options)
        several = several.withColumn("__id", F.col(id_col).cast("bigint")).join(first, ["__id", "__fp"], "left_semi")
        kept = kept.unionByName(several.dropDuplicates(["__id", "__fp"]).drop("__id", "__fp"))
    nameless = named.where("__id is null and component_id is null").select(F.col("fp").alias("__fp")).distinct()
    if nameless.limit(1).count():
        null = with_fingerprint(docs.where(F.col(id_col).isNull()), **options)
        kept = kept.unionByName(null.join(nameless, "__fp", "left_semi").drop("__fp"))
    return kept


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """The input rows with their fingerprint as ``__fp``."""
    def add(batches):
        for batch in batches:
            fp = np.array([fingerprint_of((t or "").encode(), shingle) for t in batch.column(text_col).to_pylist()], np.uint64)
            yield pa.record_batch([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, "__fp"])

    schema = StructType([*docs.schema.fields]).add("__fp", LongType())
    return docs.mapInArrow(add, schema)
