"""Compositions: chunk index (P4 part), question table (F4), search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip_ws, stripped_length
from lectern.operators import answer, chunking, embedding, search

MIN_CHUNK_CHARS = 20       # fixed: shorter chunks are not embedded


def spread(df: DataFrame, min_parts: int | None = None) -> DataFrame:
    """Give a map-only Python stage enough tasks: rows are spread round-robin.

    Only as many tasks as asked for (the cluster's cores by default) when the
    table is small; a scan of a full split per task keeps its own splits, which
    the plan's own size estimate tells without running a job.
    """
    spark = df.sparkSession
    want = min_parts or spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(want) if size < want * split else df


def embeddable(text) -> Column:
    """whether a chunk's stripped text has 20 characters or more."""
    return stripped_length(text) >= MIN_CHUNK_CHARS


def embeddable_chunks(chunks: DataFrame) -> DataFrame:
    """drop chunks whose stripped text is under 20 characters; ``chunk_id``s
    are not renumbered. (Chunks from payload messages need not be stripped.)"""
    return chunks.where(embeddable(F.col("text")))


def chunk_index(docs: DataFrame, text_col: str = "text", embedder=None,
                dim: int = embedding.HASH_DIM) -> DataFrame:
    """Documents -> embedded chunks ``(…carried, chunk_id, text, start_char, end_char, embedding)``."""
    chunks = chunking.chunk_documents(spread(docs), text_col=text_col)
    return embedding.embed(embeddable_chunks(chunks), "text", "embedding",
                           embedder=embedder, dim=dim)


def validate_questions(questions: DataFrame, text_col: str = "question",
                       top_k_col: str | None = "top_k"):
    """strip the question; blank ones are rejected, ``top_k`` defaults to 5.

    Returns ``(valid, rejected)``; rejected rows carry ``error``.
    """
    q = questions.withColumn(text_col, strip_ws(F.col(text_col)))
    bad_k = F.lit(False)
    if top_k_col and top_k_col in questions.columns:
        k = F.col(top_k_col).try_cast("int")
        bad_k = F.col(top_k_col).isNotNull() & k.isNull()        # given but not an integer
        q = q.withColumn("_bad_k", bad_k).withColumn(
            top_k_col, F.coalesce(k, F.lit(search.DEFAULT_TOP_K)))
        bad_k = F.col("_bad_k")
    else:
        q = q.withColumn("top_k", F.lit(search.DEFAULT_TOP_K))
    blank = F.col(text_col).isNull() | (F.length(text_col) == 0)
    valid = q.where(~blank & ~bad_k)
    rejected = q.where(blank | bad_k).withColumn(
        "error", F.when(blank, F.lit("the question is blank")).otherwise(F.lit("top_k is not a whole number")))
    if "_bad_k" in q.columns:
        valid, rejected = valid.drop("_bad_k"), rejected.drop("_bad_k")
    return valid, rejected


def user_questions(conversations: DataFrame) -> DataFrame:
    """Questions table from chat history: every user turn is one question."""
    return conversations.where(F.col("role") == "user").select(
        F.format_string("%d:%d", "conv_id", "turn").alias("query_id"),
        F.col("text").alias("question"),
        F.lit(None).cast(conversations.schema["conv_id"].dataType).alias("doc_id"),
    )


def embed_questions(questions: DataFrame, text_col: str = "question", embedder=None,
                    dim: int = embedding.HASH_DIM) -> DataFrame:
    """Question vectors; question text is never cut."""
    return embedding.embed(questions, text_col, "embedding", embedder=embedder, dim=dim,
                           max_chars=None)


def search_questions(index: DataFrame, questions: DataFrame, embedder=None,
                     dim: int = embedding.HASH_DIM, **kw) -> DataFrame:
    """Valid questions -> top-k hits over the chunk index."""
    valid, _ = validate_questions(questions)
    qv = embed_questions(valid, embedder=embedder, dim=dim)
    return search.exact_search(index, qv, **kw)


def ask(index: DataFrame, questions: DataFrame, embedder=None, answerer=None,
        dim: int = embedding.HASH_DIM, **kw) -> DataFrame:
    """Questions -> answers with context, prompt, sources and confidence.

    Refused questions are not answered here; :func:`respond` has a row for every question.
    """
    valid, _ = validate_questions(questions)
    qv = embed_questions(valid, embedder=embedder, dim=dim)
    hits = search.exact_search(index, qv, **kw)
    return answer.assemble_answers(valid, hits, answerer=answerer)


def respond(index: DataFrame, questions: DataFrame, embedder=None, answerer=None,
            dim: int = embedding.HASH_DIM, **kw) -> DataFrame:
    """P2 for every question asked: ``(query_id, status, body)``.

    Refused questions (F4) are not lost: they get status 400 and a body with
    the reason, like the service's reply; all others 200 and their answer.
    """
    answers = ask(index, questions, embedder=embedder, answerer=answerer, dim=dim, **kw)
    _, refused = validate_questions(questions)
    return answers.select("query_id", F.lit(200).alias("status"), answer.response_json(answers).alias("body")).unionByName(
        refused.select("query_id", F.lit(400).alias("status"), F.to_json(F.struct("error")).alias("body")))
