"""Token counts (3): finite-state tokenizer compilation, see transducer.py."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mdloom.llm.common import pieces, resident, texts


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as they are; an empty table
    gives an empty one; only the id and the text are read, so further columns may have any name. A special token's string inside a text is one token. No shuffle; a very long text is counted
    whole; a task holds about 0.7 MB of text
    (or one document) at a time and a book of at most 600,000 words.
    """

    def count(batches):
        import pyarrow as pa

        from mdloom.llm.words import count_book

        for batch in pieces(batches):
            book = resident(count_book, tokenizer_path)
            text = batch.column("text")
            n_bytes = pa.compute.binary_length(text).cast(pa.int64())
            n = pa.array(book.sums(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
