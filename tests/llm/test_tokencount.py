from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fettle.llm import tokencount as C

CODE, SIZES = C.encoder(public_tokenizers.path(C.RANKS), public_tokenizers.PATTERN)


def brute(text, rule):
    """Section counts by looking at every character of every token."""
    if not text:
        return [], 0
    section, at = [], 0
    for c in text:
        section.append(at)
        at += c == "\n"
    counts, crossing, byte = [0] * (max(section) + 1), 0, 0
    of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
    for token in CODE.encode_ordinary(text):
        n = SIZES[token]
        own = [section[k] for k in sorted(set(of_byte[byte : byte + n]))]
        byte += n
        crossing += len(set(own)) > 1
        counts[{"first": own[0], "last": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]] += 1
    return counts, crossing


def counted(text, rule):
    ids = np.array(CODE.encode_ordinary(text), np.int64)
    ends = C.line_ends(text)
    own, over = C.allot(*C.token_spans(text, ids, SIZES), ends, rule)
    return np.bincount(own, minlength=len(ends)).tolist(), int(over.sum())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\n\té日🙂.1"), min_size=1, max_size=40), st.sampled_from(C.RULES))
def test_equals_brute_force(text, rule):
    assert counted(text, rule) == brute(text, rule)


def test_crossing_tokens_follow_the_rule():
    ends = np.array([3, 5, 9])
    start, end = np.array([0, 2, 2, 4]), np.array([2, 4, 9, 6])
    assert C.allot(start, end, ends, "first")[0].tolist() == [0, 0, 0, 1]
    assert C.allot(start, end, ends, "last")[0].tolist() == [0, 1, 2, 2]
    own, over = C.allot(start, end, ends, "most")
    assert own.tolist() == [0, 0, 2, 1] and over.tolist() == [False, True, True, True]


def test_rows(spark, odd_docs, no_docs):
    named = odd_docs.withColumnsRenamed({"source": "n_tokens"})
    got = {r.doc_id: r for r in C.section_counts(named).where("doc_id IS NOT NULL").collect()}
    for r in odd_docs.where("doc_id IS NOT NULL").collect():
        counts, crossing = brute(r.text, "most")
        assert (got[r.doc_id].section_tokens, got[r.doc_id].n_crossing, got[r.doc_id].n_tokens) == (counts, crossing, sum(counts))
    assert C.section_counts(named).count() == odd_docs.count() and C.section_counts(no_docs).count() == 0
    with pytest.raises(ValueError, match="rule"):
        C.section_counts(no_docs, rule="all")
