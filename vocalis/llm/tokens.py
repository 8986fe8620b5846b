"""Token counts under a unigram vocabulary by dynamic programming over a trie.

A text is split at white space; each pre-token begins with the word mark. The distinct pre-tokens of a chunk are walked as a
trie, in sorted order: the forward scores (best score and token count of each prefix) of a shared prefix are computed once and
stay on a stack while its branches are visited; at a pre-token's end its count is stored. A document's count is the sum over
its pre-tokens, repeats included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vocalis.llm.frames import narrow
from vocalis.llm.kernels import NULL_ID, chunks, word_hashes

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stored counts of one task; the store starts anew when it is full.
STORE = 1_000_000


@dataclass
class Vocabulary:
    scores: dict[str, float | None]  # each piece's score; None for an ending of a piece that isn't one itself
    longest: int
    unknown: float  # of a character that no piece covers; it takes a token for each byte


def vocabulary(pieces: list[tuple[str, float]]) -> Vocabulary:
    known = dict(pieces)
    scores: dict[str, float | None] = dict(known)
    for piece in known:
        for i in range(1, len(piece)):
            scores.setdefault(piece[i:], None)
    return Vocabulary(scores, max(map(len, known), default=0), min(known.values(), default=0.0) - 10)


def by_rank(pieces: list[str]) -> Vocabulary:
    """Pieces from the commonest to the rarest, with the log-probabilities of Zipf's law: 1 / rank, summing to 1.

    A vocabulary made by merging stores ranks, not probabilities, and a sum of ranks would prefer many common pieces to one rare one.
    """
    whole = log(sum(1 / k for k in range(1, len(pieces) + 1))) if pieces else 0.0
    return vocabulary([(p, -log(k) - whole) for k, p in enumerate(pieces, 1)])


def load(path: str = MODEL) -> Vocabulary:
    """The ordinary pieces of a SentencePiece model file, ranked by its scores; read on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return by_rank([m.id_to_piece(i) for i in sorted(ordinary, key=lambda i: (-m.get_score(i), i))])


def counts(words: list[str], v: Vocabulary) -> list[int]:
    """Tokens of each pre-token (given without its mark), in the order given. Of equal scores the longer last piece wins."""
    out = [0] * len(words)
    order = sorted(range(len(words)), key=words.__getitem__)
    best, tokens = [0.0], [0]
    before = ""
    for k in order:
        word = MARK + words[k]
        same, most = 0, min(len(word), len(before))
        while same < most and word[same] == before[same]:
            same += 1
        del best[same + 1 :], tokens[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            top, n = best[end - 1] + v.unknown, tokens[end - 1] + len(word[end - 1].encode("utf-8", "replace"))
            for start in range(end - 1, max(0, end - v.longest) - 1, -1):
                score = v.scores.get(word[start:end], False)
                if score is False:
                    break  # no piece ends so
                if score is not None and (total := best[start] + score) >= top:
                    top, n = total, tokens[start] + 1
            best.append(top)
            tokens.append(n)
        out[k] = tokens[len(word)]
        before = word
    return out


SCHEMA = "doc_id bigint, n_pretokens bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, over its whole text.

    Null, empty and blank texts have no tokens. Equal texts have equal counts, repeated rows stay repeated, and an empty table
    gives an empty result. A very long word is one branch of the trie.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # the tokenizer's own size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: dict[bytes, int] = {}
        for _, chunk in chunks(batches):
            starts, ends, doc = chunk.words()
            _, first, which = np.unique(word_hashes(chunk.buf, starts, ends), return_index=True, return_inverse=True)
            raw = chunk.buf.tobytes()
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            if len(stored) > STORE:
                stored = {}
            new = [w for w in words if w not in stored]
            stored.update(zip(new, counts([w.decode("utf-8", "replace") for w in new], shared.value), strict=True))
            each = np.fromiter((stored[w] for w in words), dtype=np.int64, count=len(words))
            n = len(chunk.ids)
            total = np.bincount(doc, weights=each[which], minlength=n).astype(np.int64) if len(words) else np.zeros(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, mask=chunk.ids == NULL_ID), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(total)], ["doc_id", "n_pretokens", "n_tokens"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
