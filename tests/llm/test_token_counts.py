import math
import random
import re

import pytest

from cases import prose
from tillbook.llm import token_counts
from tillbook.llm.common import ready

RANKS = {b: i for i, b in enumerate([b" ", b"t", b"h", b"e", b"th", b"the", b" the", b"re", b"there", b"er", b"\n", b"he"])}


def best_count(word: bytes, scores) -> int:
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = [(best[i][0] + scores[word[i:end]], -best[i][1] - 1) for i in range(end) if scores.get(word[i:end]) is not None]
        top = max(s for s, _ in options)
        best[end] = (top, min(-n for s, n in options if s > top - 1e-9))
    return best[len(word)][1]


@pytest.mark.parametrize("ranks", [RANKS, {}, None])
def test_counts_equal_plain_dynamic_programming(ranks):
    scores = token_counts.piece_scores(token_counts.read_vocabulary(token_counts.VOCABULARY) if ranks is None else ranks)
    rng = random.Random(2)
    words = {"".join(rng.choice("theré \nx") for _ in range(rng.randrange(1, 12))).encode() for _ in range(300)} | {b"there", b"the", b" " * 40}
    assert token_counts.terminal_counts(words, scores) == {w: best_count(w, scores) for w in words}


def test_pretokens_make_up_the_text():
    for text in (b"", b" ", b"a  b", b" a\n\n b\t", b"  ", "é ü x".encode()):
        assert b"".join(re.findall(token_counts.PRETOKEN, text)) == text


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SHARE", 500)
    texts = [None, "", "  ", *[prose(n, n) for n in (1, 5, 40, 300)], "the there\n\n the"]
    docs = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    scores = token_counts.piece_scores(token_counts.read_vocabulary(token_counts.VOCABULARY))
    for r in token_counts.count(docs).collect():
        words = re.findall(token_counts.PRETOKEN, (texts[r.doc_id] or "").encode())
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(best_count(w, scores) for w in words))


def test_scores_fall_with_rank():
    scores = token_counts.piece_scores(RANKS)
    assert scores[b" "] > scores[b"t"] > scores[b"he"] > scores[b"\xff"]
    assert scores[b"her"[1:]] is not None and scores[b"here"[0:4]] is None if b"here" in scores else True
    assert math.isclose(sum(math.exp(scores[p]) for p in RANKS), 1)
