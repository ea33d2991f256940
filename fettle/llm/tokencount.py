"""Token counts by section, from one encoding of the whole document.

The document is encoded once; the token lengths in bytes give each token's span of characters. Sections are spans too, and
the two ordered lists are joined as intervals. The rule for a token that crosses a boundary is explicit:

* ``most``: it counts for the section that holds most of its characters, the earlier one on a tie (the default);
* ``first`` and ``last``: for the section of its first or last character.

A token that holds only a part of a character counts as standing on that character. So the counts of the sections always
add up to the tokens of the document. Sections here are the lines, each with its line end.

Defined results: null and empty texts have no tokens and no sections; repeated rows are counted one by one; an empty table stays empty; very long texts
are encoded whole, one at a time; other columns are kept, and one named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fettle.llm import blocks as B
from fettle.llm.arrow import field, kept_fields, map_arrow

RANKS = "byte_bpe_50k.tiktoken"
RULES = ("most", "first", "last")


def encoder(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, in characters of the text."""
    end = np.cumsum(sizes[ids])
    char = B.char_starts(np.frombuffer(text.encode(), np.uint8)) - 1
    return char[end - sizes[ids]], char[end - 1] + 1


def line_ends(text: str) -> np.ndarray:
    """The ends of the sections in characters: after each line end and at the end of the text."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)], np.int64)


def allot(start: np.ndarray, end: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token and whether it crosses a boundary."""
    first = np.searchsorted(section_ends, start, side="right")
    last = np.searchsorted(section_ends, end - 1, side="right")
    if rule == "last":
        return last, first != last
    own = first.copy()
    if rule == "most":
        for k in np.flatnonzero(first != last):
            edges = np.concatenate([[start[k]], section_ends[first[k] : last[k]], [end[k]]])
            own[k] = first[k] + int(np.argmax(np.diff(edges)))
    return own, first != last


def _count(batches: Iterator[pa.RecordBatch], text: str, kept: list[str], path: str, pattern: str, rule: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    code, sizes = encoder(path, pattern)
    for batch in batches:
        totals, crossing, counts = [], [], []
        for value in batch[text]:
            whole = value.as_py() or ""
            ids = np.array(code.encode_ordinary(whole), np.int64)
            totals.append(len(ids))
            ends = line_ends(whole) if whole else np.zeros(0, np.int64)
            own, over = allot(*token_spans(whole, ids, sizes), ends, rule) if len(ids) else (ids, ids)
            crossing.append(int(over.sum()))
            counts.append(np.bincount(own, minlength=len(ends)).tolist())
        mine = [pa.array(totals, pa.int64()), pa.array(crossing, pa.int64()), pa.array(counts, schema.field("section_tokens").type)]
        yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + mine, schema=schema)


def section_counts(docs: DataFrame, text: str = "text", rule: str = "most", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_crossing and section_tokens (a count for each line); narrow."""
    import public_tokenizers

    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    own = [field("n_tokens", T.LongType()), field("n_crossing", T.LongType()), field("section_tokens", T.ArrayType(T.LongType()))]
    kept = [c for c in docs.columns if c != text and c not in {f.name for f in own}]
    rows = docs.select(*kept, text)
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    return map_arrow(rows, _count, kept_fields(rows, kept) + own, text=text, kept=kept, path=path, pattern=pattern, rule=rule)
