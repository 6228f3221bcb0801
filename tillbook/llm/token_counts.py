"""Token counts under a unigram model, with scores shared between common prefixes.

The distinct pre-tokens of some megabytes of text are sorted, which is the order of a
depth-first walk of their trie. Best scores are computed once per trie node and kept
for the path to the node at hand; each pre-token's count is stored at its end.
"""

from __future__ import annotations

import base64
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Pre-tokens are words with a space before them, and other runs of white space; joined
# they give the text again.
PRETOKEN = rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= ?[^\x20\x09-\x0D]|\Z)"
# Bytes of text whose pre-tokens share a trie.
SHARE = 8 << 20


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Pieces and ranks from a file of base64 pieces with their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, float | None]:
    """Log chance of each piece, and None for byte strings that only end a piece.

    The file has ranks, no chances: a piece's chance falls with its rank by Zipf's
    law. Bytes that are no piece score below all pieces.
    """
    norm = math.log(sum(1 / (rank + 1) for rank in ranks.values()) or 1)
    scores: dict[bytes, float | None] = {piece[i:]: None for piece in ranks for i in range(1, len(piece))}
    scores |= {piece: -math.log(rank + 1) - norm for piece, rank in ranks.items()}
    unknown = min([s for s in scores.values() if s is not None], default=0.0) - 10
    for code in range(256):
        if scores.get(bytes([code])) is None:
            scores[bytes([code])] = unknown
    return scores


def terminal_counts(pretokens: set[bytes], scores: dict[bytes, float | None]) -> dict[bytes, int]:
    """Number of pieces in the best segmentation of each pre-token, fewer if tied."""
    counts: dict[bytes, int] = {}
    best, pieces = [0.0], [0]  # by depth, along the path to the node at hand
    before = b""
    missing = object()
    get = scores.get
    for word in sorted(pretokens):
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], pieces[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, fewest, start = -math.inf, 0, end - 1
            while start >= 0:
                score = get(word[start:end], missing)
                if score is missing:
                    break  # no piece ends like this, nor with more before it
                if score is not None:
                    total = best[start] + score
                    if total > top + 1e-9 or total > top - 1e-9 and pieces[start] + 1 < fewest:
                        top, fewest = total, pieces[start] + 1
                start -= 1
            best.append(top)
            pieces.append(fewest)
        counts[word] = pieces[len(word)]
        before = word
    return counts


def count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, n_pretokens, n_tokens`` of every row; NULL and empty texts have
    none, repeated rows give equal rows, an empty table gives none."""
    scores = docs.sparkSession.sparkContext.broadcast(piece_scores(read_vocabulary(vocabulary)))
    pattern, share = PRETOKEN, SHARE

    def counted(batches):
        find = re.compile(pattern).findall
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                held.append((doc_id, len(text or b""), find(text or b"")))
                size += len(text or b"")
                if size >= share:
                    yield tallied(held)
                    held, size = [], 0
        if held:
            yield tallied(held)

    def tallied(held: list[tuple]) -> pa.RecordBatch:
        number = terminal_counts({w for _, _, words in held for w in words}, scores.value).__getitem__
        rows = [(doc_id, n, len(words), sum(map(number, words))) for doc_id, n, words in held]
        kinds = [id_kind, pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    id_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_pretokens bigint, n_tokens bigint")
