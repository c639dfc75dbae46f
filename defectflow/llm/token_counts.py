"""Token counts by trie-shared dynamic programming.

A text's pre-tokens are its words, each with the word mark of the vocabulary before it. The tokens of a pre-token are the best segmentation into vocabulary pieces under a
unigram model. The scores are those of the file if it holds a unigram model; the given public files hold none, and tokenizers aren't trained here, so for the other kinds the file's order stands for frequency, by Zipf's law. A character
without a piece costs one unknown token for each of its bytes.
In a task, the distinct pre-tokens of a bounded batch are put in a trie: a node is a shared prefix, and holds the best forward score and the
tokens of its best path, computed once from the nodes above it. Sorted pre-tokens visit the trie in depth-first order, so only the current path is in memory; a pre-token's
terminal node stores its count. From each end the pieces are looked up from the shortest on, and the walk stops where no piece ends in these characters. Nothing is shuffled.

Defined results: a null or empty text has 0 words and 0 tokens; equal scores prefer fewer tokens; repeated rows each get their row; an empty table
gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import pieces, word_bytes

MARK = "▁"
UNKNOWN = -30.0


def piece_scores(path: str | None = None) -> dict[str, float]:
    """Pieces of a sentencepiece file with the log of 1 / (rank * H): ordinary pieces in the file's order, without control and byte pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    names = [model.id_to_piece(i) for i in ids]
    scores = [model.get_score(i) for i in ids]
    if abs(sum(map(math.exp, scores)) - 1) < 0.2:  # log probabilities: a unigram model
        return dict(zip(names, scores, strict=True))
    total = math.log(sum(1 / r for r in range(1, len(names) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(names, 1)}


class Trie:
    def __init__(self, scores: dict[str, float]):
        #: Every ending of a piece; the piece's score, or None if it is no piece itself.
        self.endings: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))}
        self.endings.update(scores)

    def counts(self, words: list[str]) -> dict[str, int]:
        """Terminal counts of distinct pre-tokens."""
        endings, out = self.endings, {}
        best, used, before = [0.0], [0], ""  # of each node on the path: forward score, tokens
        for word in sorted(words):
            depth = 0
            limit = min(len(word), len(before))
            while depth < limit and word[depth] == before[depth]:
                depth += 1
            del best[depth + 1 :], used[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "replace"))
                top, least = best[end - 1] + UNKNOWN * n, used[end - 1] + n
                for start in range(end - 1, -1, -1):
                    score = endings.get(word[start:end], 1.0)
                    if score is None:
                        continue
                    if score > 0:  # no piece ends so
                        break
                    score += best[start]
                    if score > top or score == top and used[start] + 1 < least:
                        top, least = score, used[start] + 1
                best.append(top)
                used.append(least)
            out[word] = used[-1]
            before = word
        return out


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of each row. ``vocabulary``: path of a sentencepiece file on the driver."""
    scores = docs.sparkSession.sparkContext.broadcast(piece_scores(vocabulary))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(scores.value)
        for frame in pieces(frames, limit=8_000_000):
            texts = [word_bytes(t) for t in frame["text"]]
            counts = trie.counts([MARK + w.decode() for w in {w for one in texts for w in one}])
            by_word = {w[1:].encode(): n for w, n in counts.items()}
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_words": [len(t) for t in texts], "n_tokens": [sum(map(by_word.__getitem__, t)) for t in texts]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(run, "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
