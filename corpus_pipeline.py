"""From raw documents to tokens: five stages, each over all that the one before kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. What holds for all of
them: rows are numbered, so null and repeated ids don't matter and each row is judged by its own text;
null texts count as empty; an empty table gives an empty one; columns besides those of documents, whatever
their names, go along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import byte_bpe, decontaminate, exact_dedup, language_id, ngram_join
from clausewright.llm.common import Scratch, fold, read, small

def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents with a number for each row, stored so that the numbers hold, and the number's column, a name of no other."""
    row, taken = "__row", {c.lower() for c in docs.columns}
    while row in taken:
        row += "_"
    return Scratch(docs.sparkSession, name).table(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, or no letter in it) go; a very long text is parsed whole.

    Without any labelled text nothing can be told, and all go. Repeated rows stay or go together.
    """
    samples = language_id.learn(docs.filter(fold("doc_id", 4) != 2))
    told = language_id.predict(docs, samples, extra={"__kept": F.struct(*docs.columns)})
    return told.filter(F.col("lang_pred") != language_id.UNDETERMINED).select("__kept.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays, then the one with the smallest id.

    Of rows that tie in both, repeated ones among them, exactly one stays; null ids lose ties; empty texts
    are equal, so one of them stays.
    """
    rows, row = _numbered(docs, "drop_copies")
    kept = exact_dedup.exact_dedup(rows, row_col=row).filter("kept").select(row)
    return rows.join(kept, row, "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of similar pairs connect, the one with the smallest id stays.

    A text of one to four words is one shingle; texts without words are similar to nothing and all stay;
    repeated rows are one group; very long texts count with all their shingles.
    """
    rows, row = _numbered(docs, "drop_near_copies")
    kept = ngram_join.similar_documents(rows, row_col=row).filter("first").select(row)
    return rows.join(kept, row, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go, each row by its own text.

    Null and empty items are in no document; repeated rows go together; very long texts are searched whole.
    """
    rows, row = _numbered(docs, "drop_contaminated_rows")
    found = decontaminate.find_contamination(rows, read(spark, sf_dir, "benchmark"), row_col=row).select(row).distinct()
    found = small(Scratch(spark, "drop_contaminated").table(found, "found"))
    return rows.join(found, row, "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's tokens and of the bytes they decode to: a row for each row, repeated ones too.

    An empty text has no token and the digests of nothing.
    """
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL can't express the stages of language ID and of tokens; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows stored before the next reads them; the last stage's rows.

    An empty table goes through all stages and gives no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        if before is not None:
            scratch.drop(before)
        before = str(k)
    return docs
