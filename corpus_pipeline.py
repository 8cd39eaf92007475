"""From raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns what goes on; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, overlap, packing, pii, quality
from quern.llm._common import cut, stored, table
from quern.llm.queries import vocabulary

#: Ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 200_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts score as empty; rows are judged by their texts alone, so equal texts
    stay or go together; without labels every document stays.
    """
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = "_quality_score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, trees, docs.columns, name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id stays.

    Groups are of texts, documents are rows: null and repeated ids are told apart by
    their texts, rows that repeat an id and its text are one document, a null id is
    the largest. Null counts as empty, texts without words are copies of each other.
    """
    keyed = docs.select("doc_id", overlap.hashed(F.col("text")).alias("text_key"), _whole(docs))
    roots = overlap.near_copies(docs)
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots
    ids = keyed.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    ids = cut(ids.join(roots, F.col("text_key") == F.col("h"), "left").select("doc_id", "text_key", "n", F.coalesce("root", "text_key").alias("root")))
    # Null ids come last, so a group keeps one only if it has no other.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    groups = cut(ids.groupBy("root").agg(F.min(place).alias("best"), F.count("*").alias("rows")).where("rows > 1").select("root", "best"))
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups
    gone = cut(ids.join(groups, "root").where(~F.col("best").eqNullSafe(place)).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left_anti")
    kept = kept if ids.where("n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text_key"])
    return kept.select("row.*")


def _whole(docs: DataFrame, *but: str) -> Column:
    """All columns of a row (but those named) as one, so that none of their names meets a stage's own."""
    return F.struct(*[c for c in docs.columns if c not in but]).alias("row")


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, disclosing terms are generalised or removed; n_chars follows the text.

    Null texts come out empty; each row is masked by itself, whatever its id.
    """
    found = pii.sanitise(docs.select("doc_id", "text", _whole(docs, "text")), payload=["row"])
    masked = found.select("row", pii.masked(F.col("text")).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return masked.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, its copies beside it.

    Rows that are equal in all columns share what they take together; null sources are
    one source; texts without words are taken once or twice, as their source is, at random.
    """
    # Nested values have nulls of their own, and maps no hash: both go as JSON. Each column says whether it is null, as hashes skip nulls.
    plain = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if "<" in kind else F.col(c) for c, kind in docs.dtypes]
    told = [x for c, p in zip(docs.columns, plain) for x in (F.col(c).isNull(), p)]
    row_key = F.concat_ws("-", *[F.xxhash64(*told, F.lit(seed)).cast("string") for seed in (1, 2)])
    keyed = docs.select("doc_id", "text", "source", row_key.alias("row_key"), _whole(docs))
    taken = mixing.mix(keyed, payload=["row_key"]).groupBy("doc_id", "row_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = cut(taken.select(F.col("doc_id").alias("of_id"), F.col("row_key").alias("of_key"), "copies", "rows"))
    keyed = keyed.select("doc_id", "row_key", "row")
    if not taken.where("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", "row_key"])
    mixed = keyed.join(taken.where("copies > 0"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key")))
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of one capacity. Null texts are empty, their one piece is the end id; every row is packed, whatever its id."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("pii", pii_masking), ("mixing", source_mixing), ("packing", sequence_packing)]

#: Trained trees, hashes with a seed and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
