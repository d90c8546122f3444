"""P4 ingest: documents -> rejects, chunks, catalog, embedded chunk index."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import catalog as cat
from lectern.operators import chunking, embedding
from lectern.plans import retrieval
from lectern.session import stored

# Fixed upload time used by the registered queries, so results are reproducible.
FIXED_UPLOAD = _dt.datetime(2024, 1, 1, 0, 0, 0)


@dataclass
class Ingested:
    rejects: DataFrame     # (doc_id, reason)
    chunks: DataFrame      # (doc_id, chunk_id, text, start_char, end_char)
    catalog: DataFrame     # one row per accepted document
    index: DataFrame | None  # embeddable chunks with ``embedding``
    index_keys: DataFrame  # ``(doc_id, chunk_id)`` of the index rows, without computing vectors


def uploads_from_documents(docs: DataFrame) -> DataFrame:
    """The driver's ``documents`` table seen as uploaded objects.

    Each document is the object ``<source>/<doc_id>.pdf`` in bucket
    ``corpus-<lang>``; its size is the UTF-8 byte length of its text.
    """
    return docs.select(
        "doc_id", "text",
        F.concat(F.lit("corpus-"), F.col("lang")).alias("bucket"),
        F.format_string("%s/%d.pdf", "source", "doc_id").alias("s3_key"),
        F.octet_length("text").cast("bigint").alias("file_size"),
    )


def ingest(uploads: DataFrame, upload_date=None, embedder=None,
           dim: int = embedding.HASH_DIM, materialize: bool = False, keep_text: bool = True) -> Ingested:
    """Reject short documents, chunk the rest, derive catalog rows and vectors.

    ``uploads`` has ``doc_id, text, bucket, s3_key, file_size``. With
    ``materialize`` the chunk table is written once to the shared checkpoint
    folder (lineage cut there), so a plan that uses both the catalog and the
    index reads the chunks instead of walking every document twice; otherwise
    everything stays lazy. Reports that need no chunk text pass
    ``keep_text=False``: the stored chunks are keys, offsets and counts, and
    there is no ``index``.
    """
    accepted, rejects = cat.split_short_documents(retrieval.spread(uploads))
    docs = accepted.withColumn("total_characters", F.length("text").cast("bigint"))
    chunks = chunking.chunk_documents(docs).withColumn("_embeddable", retrieval.embeddable(F.col("text")))
    if materialize:
        chunks = stored(chunks if keep_text else chunks.drop("text"), "chunks")
    when = cat.utc_stamp(upload_date) if upload_date is not None else cat.utc_stamp()
    catalog = cat.catalog_from_chunks(chunks, when)
    columns = [c for c in ("doc_id", "chunk_id", "text", "start_char", "end_char") if c in chunks.columns]
    kept = chunks.where("_embeddable").select(*columns)
    index = embedding.embed(kept, "text", "embedding", embedder=embedder, dim=dim) if "text" in columns else None
    return Ingested(rejects=rejects, chunks=chunks.select(*columns), catalog=catalog, index=index,
                    index_keys=kept.select("doc_id", "chunk_id"))


def embedding_results(index: DataFrame, generated_at=None) -> DataFrame:
    """Status rows an embedding job reports: ``(doc_id, embeddings_count, embeddings_generated_at)``.

    ``index`` may be the written vector table or just its keys (the embedder
    maps rows one to one, so counting keys does not need the vectors).
    """
    when = cat.utc_stamp(generated_at) if generated_at is not None else cat.utc_stamp()
    return cat.embeddings_count(index).withColumn("embeddings_generated_at", when)
