"""Token counts by a public byte-level tokenizer, read from a rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same cuts with the white space named, for a matcher whose stack doesn't grow with the text.
_CUTS = regex.compile(_PIECES.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

#: Longer texts are cut into pieces here, and not by the encoder, whose matcher breaks off in
#: long runs of white space; the tokens are the same.
LONG = 4096


def load_encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoder: tiktoken.Encoding, text: str | None) -> int:
    """Tokens of the whole text. No token crosses the border of two pieces, so pieces may be encoded one by one."""
    if not text:
        return 0
    if len(text) <= LONG:
        return len(encoder.encode_ordinary(text))
    known: dict[str, int] = {}
    total = 0
    for m in _CUTS.finditer(text):
        piece = m.group()
        if piece not in known:
            known[piece] = len(encoder.encode_ordinary(piece)) if len(piece) <= LONG else len(encoder._core_bpe.encode_single_piece(piece.encode("utf-8", "replace")))
        total += known[piece]
    return total


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """All columns but ``text``, and the number of tokens of ``text`` (0 for null and empty texts)."""
    rest = [c for c in df.columns if c != text]
    source = df.select(*rest, F.col(text).alias("_text"))
    fields = [f for f in source.schema if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` bigint"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path)
        for batch in batches:
            n = pa.array([count_tokens(encoder, t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*[f.name for f in fields], out])

    return source.mapInArrow(count, schema)
