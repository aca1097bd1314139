"""Token counts under a unigram vocabulary, by dynamic programming that a trie shares.

The best score of a prefix depends on the prefix alone, so distinct pre-tokens are put in a trie and a
node's forward score is computed once, however many pre-tokens run through it. A node also keeps the
tokens of its best segmentation; where a pre-token ends, that is its count. A task keeps one trie
for all its texts and starts a new one when it has ``NODES`` nodes. A pre-token of over ``LONG`` characters has
no prefix worth sharing: it runs through the same recurrence over the last prefixes only, as
many as the longest piece has characters, so its memory does not follow its length.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents

#: Nodes of a task's trie, some 200 bytes each.
NODES = 600_000
#: Characters of the longest pre-token that goes into the trie.
LONG = 1000

#: The mark that stands for the blank before a word.
MARK = "▁"


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities by rank in the list: 1 / (rank + 2.7), normalized."""
    weights = [1 / (i + 3.7) for i in range(len(pieces))]
    total = math.log(sum(weights))
    return {p: math.log(w) - total for p, w in zip(pieces, weights)}


def vocabulary(model: str) -> tuple[dict[str, float], float]:
    """Scores of a sentencepiece file's pieces, and the score of one byte of a character that has none.

    Pieces are ranked by the file's own scores, best first. Control and byte pieces are no text.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    scores = zipf_scores([sp.id_to_piece(i) for i in sorted(ids, key=lambda i: (-sp.get_score(i), i))])
    return scores, min(scores.values()) - 1.0


class Trie:
    """Forward scores of prefixes.

    Nodes are numbers; ``child`` has the node below a node by a character, ``best`` each node's score
    and ``tokens`` its segmentation's tokens.
    """

    def __init__(self, scores: dict[str, float], byte_score: float, nodes: int = NODES, long: int = LONG):
        self.scores, self.byte_score, self.limit, self.long = scores, byte_score, nodes, long
        self.longest = max(map(len, scores), default=1)
        #: Ends of pieces: when a substring is none of them, no longer one that ends there is a piece.
        self.ends: set[str] = {p[i:] for p in scores if len(p) > 1 for i in range(len(p))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.counts: dict[str, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """(tokens, score) of the best segmentation; of equal scores the one of fewer tokens."""
        if len(word) > self.long:
            return self._run(word)
        found = self.counts.get(word)
        if found is None:
            if len(self.best) >= self.limit:
                self.clear()
            found = self.counts[word] = self._insert(word)
        return found

    def _run(self, word: str) -> tuple[int, float]:
        """The count of a long word: (score, tokens) of the last prefixes alone."""
        last: deque[tuple[float, int]] = deque([(0.0, 0)], self.longest)  # of the prefixes before this character
        for j, c in enumerate(word, 1):
            best, tokens = last[-1]
            one = self.scores.get(c)
            n = 1 if one is not None else len(c.encode("utf-8", "surrogatepass"))
            best, tokens = best + (one if one is not None else n * self.byte_score), tokens + n
            for i in range(j - 2, max(-1, j - 1 - len(last)), -1):
                piece = word[i:j]
                if piece not in self.ends:
                    break
                s = self.scores.get(piece)
                if s is not None:
                    before, n = last[i - j]
                    if s + before > best or (s + before == best and n + 1 < tokens):
                        best, tokens = s + before, n + 1
            last.append((best, tokens))
        return last[-1][1], last[-1][0]

    def _insert(self, word: str) -> tuple[int, float]:
        scores, ends, child, all_best, all_tokens = self.scores, self.ends, self.child, self.best, self.tokens
        path = [0]  # the node of each prefix
        node = 0
        for j, c in enumerate(word, 1):
            key = node * 0x110000 + ord(c)
            node = child.get(key, 0)
            if not node:
                one = scores.get(c)
                if one is None:
                    n = len(c.encode("utf-8", "surrogatepass"))
                    best, tokens = all_best[path[-1]] + n * self.byte_score, all_tokens[path[-1]] + n
                else:
                    best, tokens = all_best[path[-1]] + one, all_tokens[path[-1]] + 1
                for i in range(j - 2, -1, -1):
                    piece = word[i:j]
                    if piece not in ends:
                        break
                    s = scores.get(piece)
                    if s is not None:
                        s += all_best[path[i]]
                        if s > best or (s == best and all_tokens[path[i]] + 1 < tokens):
                            best, tokens = s, all_tokens[path[i]] + 1
                node = child[key] = len(all_best)
                all_best.append(best)
                all_tokens.append(tokens)
            path.append(node)
        return all_tokens[node], all_best[node]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) to doc_id, n_words, n_tokens and score, the log-probability of the best segmentation.

    A pre-token is the blank's mark and a word of the pattern WORD. Null and empty texts have no
    tokens; repeated rows give repeated rows; a text is counted whole, whatever its length; other
    columns are left out. ``model`` is a file of public_tokenizers or a path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import public_tokenizers

        trie = Trie(*vocabulary(model if "/" in model else public_tokenizers.path(model)))
        words = re.compile(WORD).findall
        for batch in batches:
            n_words, n_tokens, score = [], [], []
            for text in batch.column(1):
                own = Counter(words(text.as_py() or ""))
                n, total = 0, 0.0
                for word, m in own.items():
                    t, s = trie.count(MARK + word)
                    n += m * t
                    total += m * s
                n_words.append(own.total())
                n_tokens.append(n)
                score.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_words", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, score double")


def op1_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(documents(spark, sf_dir)).withColumn("score", F.round("score", 4))
