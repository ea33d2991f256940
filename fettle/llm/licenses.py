"""License notices in texts, exact phrases and notices with a few edits.

A text is lower-cased (A-Z) and laid out as words with single spaces. Phrases are found where their words stand one after
another. A notice of length n may have up to ``edits`` character edits: cut into ``edits + 1`` pieces, one piece at least
stands unchanged in any such copy, so every place of every piece is a candidate. Around each, the regex library's
bounded-error search verifies the edits and gives the best span, which begins and ends with whole words.

Defined results: null and empty texts have no words and no labels; repeated rows are scanned one by one; an empty table stays empty; very
long texts are scanned whole, one at a time; a document column named like a result is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fettle.llm import blocks as B
from fettle.llm.arrow import kept_fields, map_arrow

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices, their labels and how many edits they may have.
NOTICES = (
    ("mit license", "mit", 1),
    ("apache license", "apache", 1),
    ("general public license", "gpl", 2),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("gnu general public license as published by the free software foundation", "gpl", 6),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("licensed under a creative commons attribution", "cc", 4),
    ("licensed under cc by", "cc", 1),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
)
PLAIN = bytes(x if B.LETTERS[x] else 32 for x in B.LOWER.tolist())
SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
                     T.StructField("edits", T.LongType())])
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(SPAN)),
    T.StructField("fuzzy", T.ArrayType(SPAN)),
    T.StructField("score", T.DoubleType()),
]


def layout(text: str | None) -> tuple[bytes, int]:
    """The words with a space before and after each, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" " if words else b"", len(words)


def every(where: bytes, what: bytes) -> Iterator[int]:
    at = where.find(what)
    while at >= 0:
        yield at
        at = where.find(what, at + 1)


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """The notice cut into ``edits + 1`` pieces of nearly the same length, with their offsets."""
    n = len(notice)
    cuts = [n * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = [(len(p), label, k, pieces(p, k), regex.compile(b"(?e)(?<= )(?:%s){e<=%d}(?= )" % (re.escape(p).encode(), k))) for p, label, k in notices]

    def exact(self, text: bytes) -> list[dict]:
        out = []
        for phrase, label in self.phrases:
            word = last = 0
            for at in every(text, phrase):
                word, last = word + text.count(b" ", last, at), at
                out.append({"label": label, "first_word": word, "n_words": phrase.count(b" ") - 1, "edits": 0})
        return out

    def fuzzy(self, text: bytes) -> tuple[list[dict], float]:
        """The spans of notices with at most their edits, and the best likeness."""
        spans, best = {}, 0.0
        for length, label, edits, seeds, pattern in self.notices:
            windows = sorted({max(0, at - offset - edits - 1) for offset, seed in seeds for at in every(text, seed)})
            merged: list[list[int]] = []
            for start in windows:
                end = start + length + 2 * edits + 2
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = end
                else:
                    merged.append([start, end])
            word = last = 0
            for start, end in merged:
                for found in pattern.finditer(text, start, min(len(text), end + 1)):
                    word, last = word + text.count(b" ", last, found.start()), found.start()
                    key, wrong = (label, word - 1, text.count(b" ", found.start(), found.end()) + 1), sum(found.fuzzy_counts)
                    spans[key] = min(spans.get(key, wrong), wrong)
                    best = max(best, 1 - wrong / length)
        return [{"label": a, "first_word": w, "n_words": n, "edits": e} for (a, w, n), e in sorted(spans.items())], best


def _scan(batches: Iterator[pa.RecordBatch], text: str, kept: list[str], schema: pa.Schema, phrases, notices) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(phrases, notices)
    for batch in batches:
        rows = []
        for value in batch[text]:
            laid, n = layout(value.as_py())
            exact, (fuzzy, best) = scanner.exact(laid), scanner.fuzzy(laid)
            rows.append((n, exact, fuzzy, max(best, 1.0 if exact else 0.0)))
        own = [pa.array([r[i] for r in rows], schema.field(len(kept) + i).type) for i in range(len(RESULT))]
        yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + own, schema=schema)


def scan(docs: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, places (exact phrases), fuzzy (notice spans with their edits) and score; narrow."""
    own = {f.name for f in RESULT}
    rows = docs.select(*[c for c in docs.columns if c not in own or c == text])
    kept = [c for c in rows.columns if c not in own and (keep_text or c != text)]
    return map_arrow(rows, _scan, kept_fields(rows, kept) + RESULT, text=text, kept=kept, phrases=phrases, notices=notices)
