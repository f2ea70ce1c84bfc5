"""Token ids of a public byte-level BPE vocabulary.

The vocabulary file is the tokenizers library's JSON; encoding its merges goes through tiktoken's
engine, which gives the same ids several times faster (tests/llm compare the two on whole tables).
Texts that hold an added token's string go through the tokenizers library itself, as do runs of
LONG_BLANK or more white space characters, on which the engine's pattern overflows its stack.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import extended

LONG_BLANK = 10_000
#: Unicode white space.
_BLANK = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", ()))


@functools.lru_cache(maxsize=2)
def library(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


def token_ids(path: str, text: str | None) -> np.ndarray:
    """Ids of a whole text, little-endian unsigned 32-bit; special tokens' strings are ordinary text, null is empty.

    The pattern makes all of a long run of white space one piece, less its last character where a word
    follows, so the text can be cut there.
    """
    if not text:
        return np.zeros(0, "<u4")
    parts, at = [], 0
    for run in _BLANK.finditer(text) if len(text) >= LONG_BLANK else ():
        end = run.end() - (run.end() < len(text))
        parts += [encoder(path).encode_ordinary(text[at : run.start()]), library(path).encode(text[run.start() : end], add_special_tokens=False).ids]
        at = end
    parts.append(encoder(path).encode_ordinary(text[at:]))
    return np.concatenate([np.array(p, "<u4") for p in parts])


def text_ids(path: str, text: str | None) -> np.ndarray:
    """As token_ids, but added tokens' strings get their own ids, as the tokenizers library has it by default; it adds none itself."""
    if text and any(token in text for token in added_tokens(path)):
        return np.array(library(path).encode(text, add_special_tokens=False).ids, "<u4")
    return token_ids(path, text)


def count_tokens(docs: DataFrame, text_col: str, path: str, keep: list[str]) -> DataFrame:
    """The columns keep and n_tokens long (a null text has 0)."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    out = extended(rows.drop("_text").schema, "n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(text_ids(path, t.as_py())) for t in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, out)
