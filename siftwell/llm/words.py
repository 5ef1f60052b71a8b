"""Words of many texts at once, by Arrow kernels; whole texts, any length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space (space, \\t to \\r): offsets of each text's words, and the words.

    Null and empty texts have none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat, offsets = lists.flatten(), offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return kept[offsets], flat.filter(full) if kept[-1] < len(flat) else flat


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of each text's words, the words as codes, and the distinct words by code."""
    offsets, flat = ascii_words(texts)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each piece, one piece after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
