"""Token counts of a byte-level BPE: whole tokens by lookup, merges only for the rest.

The tokenizer's file is read once, on the driver, and the vocabulary strings that encode alone as one
token are proven there by encoding each of them. Texts are cut into pre-tokens by the tokenizer's own
split pattern; merges never cross pre-tokens, so a text has as many tokens as its pre-tokens together.
A pre-token that is a proven string counts one; only others are merged, by the tokenizer's library.
The library's character tables may be older than ours, so each character beyond ASCII is tried once, and
a piece of text with one that is split otherwise goes to the library whole.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.textkit import slices

#: A text of more tokens is over the limit.
LIMIT = 512
#: Split pattern of byte-level tokenizers, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are cut into pre-tokens at a time; merged pre-tokens remembered, and their length.
BLOCK, REMEMBERED, SHORT = 1 << 18, 1 << 18, 64


def proven_tokens(tokenizer) -> list[str]:
    """Vocabulary strings that encode alone as their own one token."""
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [text for i, text, e in zip(ids, texts, encoded) if "�" not in text and e.ids == [i]]


def added_tokens(definition: str) -> list[str]:
    """The special strings that the tokenizer finds inside texts, longest first.

    Raises ValueError for a tokenizer of another kind than byte-level BPE, whose texts are split in
    another way.
    """
    found = json.loads(definition)
    split = found.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level tokenizers without a prefix space are supported")
    if found.get("normalizer") or found["model"].get("ignore_merges") or found["model"].get("dropout"):
        raise ValueError("normalizers, ignored merges and dropout are not supported")
    added = found.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take their surroundings are not supported")
    return sorted((t["content"] for t in added), key=lambda t: (-len(t), t))


class _Counts(dict):
    """Tokens of a pre-token: 1 for proven strings, and the merged others that are remembered."""

    def __init__(self, definition: str, proven: list[str]):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        super().__init__(dict.fromkeys(proven, 1))
        self.room = len(self) + REMEMBERED
        self.settled, self.unsettled = set(), set()

    def agrees(self, text: str) -> bool:
        """Whether the library splits every character of the text as the pattern does; each is tried once."""
        if text.isascii():
            return True
        for char in (used := set(text)) - self.settled:
            probe = f"a{char}1{char}!{char} "
            split = [piece.span() for piece in _PIECE.finditer(probe)]
            same = split == [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            self.settled.add(char)
            if not same:
                self.unsettled.add(char)
        return not used & self.unsettled

    def merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece)
        if len(piece) <= SHORT and len(self) < self.room:
            self[piece] = n
        return n


_PIECE = regex.compile(PATTERN)
_BOUNDARY = regex.compile(r"\S(?=\s)")


def blocks(text: str):
    """The text in pieces of about BLOCK characters, cut before white space, where a pre-token always begins."""
    at = 0
    while len(text) - at > BLOCK and (cut := _BOUNDARY.search(text, at + BLOCK)):
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def counter(definition: str, proven: list[str], special: list[str]):
    """A function from a text to its number of tokens."""
    counts, pieces = _Counts(definition, proven), _PIECE.findall
    specials = regex.compile("|".join(map(regex.escape, special))) if special else None

    def ordinary(text: str) -> int:
        return sum(
            sum(map(counts.__getitem__, pieces(block))) if counts.agrees(block) else counts.merged(block) for block in blocks(text))

    def count(text: str | None) -> int:
        if not text:
            return 0
        if specials is None or not specials.search(text):
            return ordinary(text)
        parts = specials.split(text)
        return len(parts) - 1 + sum(map(ordinary, parts))

    return count


def _counting(definition: str, proven: list[str], special: list[str], limit: int, schema: pa.Schema):
    def run(batches):
        count = counter(definition, proven, special)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                tokens = np.array([count(t.as_py()) for t in texts], dtype=np.int64)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(tokens), pa.array(tokens > limit)], schema=schema)

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``tokenizer_path`` is a file of a byte-level BPE tokenizer, readable where the driver runs; tasks
    get its contents. No begin or end tokens are counted, special strings inside a text count as their
    one token, nothing is cut or padded. A null or empty text has 0 bytes and tokens. Repeated rows are
    counted each, a null id is kept, other columns are ignored.

    A pre-token is merged whole, in time n log n; a text of n characters without white space is one
    pre-token at the most. ``limit`` only sets ``over_limit``.
    """
    from tokenizers import Tokenizer

    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    special = added_tokens(definition)
    proven = proven_tokens(Tokenizer.from_str(definition))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    id_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
    schema = pa.schema([("id", id_arrow), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    found = rows.mapInArrow(
        _counting(definition, proven, special, limit, schema), f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("id", id_col)
