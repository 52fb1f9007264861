"""Token counts by a public tokenizer whose vocabulary is a file of ranks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file: a token in base64 and its rank per line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how a byte-level BPE of this kind splits text before it merges bytes.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in parts that end where the split pattern ends a part anyway.
PART_CHARS = 200_000
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about `size` characters, cut before a single space between two letters; the tokens of the
    parts are those of the text."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encoder(vocabulary: bytes):
    """encode(text) -> list of token ids."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: [t for p in parts(text) for t in own.encode_ordinary(p)]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens): the number of tokens of each whole text. Null and empty texts have none and no row.

    The vocabulary file is read once and sent along; its size does not depend on the data.
    """
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(encode(t.as_py())) for t in b.column("text")], pa.int64())], names=["doc_id", "tokens"])

    return documents.where("text is not null and text != ''").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, tokens bigint")
