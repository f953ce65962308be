"""Token counts under a unigram vocabulary, with forward scores shared by prefix in a trie.

Texts are cut into pre-tokens. A trie node is a prefix of pre-tokens; its forward score is the best sum of piece scores
that spells it, and the score of a child needs those of its ancestors only. So a prefix that many pre-tokens share is
scored once. The node where a pre-token ends stores its token count. Each task keeps one trie for all its texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Score of a byte that no piece spells, and the tokens it counts for.
UNKNOWN = -30.0


def load_vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a rank file (base64 piece, rank) with Zipf scores -ln((rank + 1) H): no model is trained."""
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -log(r + 1) - norm for piece, r in ranks.items()}


class PrefixTrie:
    """Forward scores and token counts of pre-tokens, one node for each prefix."""

    #: Nodes kept at most; beyond that the trie starts anew, which changes no count.
    MAX_NODES = 400_000
    #: Bytes of a pre-token that goes through the trie; a longer one shares no prefix of note and is scored on its own.
    LONGEST = 4096

    def __init__(self, vocabulary: dict[bytes, float]):
        # each suffix of a piece: the piece's score, or None if no piece ends the walk there
        self.suffixes: dict[bytes, float | None] = {}
        for piece, score in vocabulary.items():
            for k in range(1, len(piece)):
                self.suffixes.setdefault(piece[k:], None)
        self.suffixes.update(vocabulary)
        self.reach = max(map(len, vocabulary), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.score, self.tokens = array("d", [0.0]), array("q", [0])
        self.terminal: dict[str, tuple[int, float]] = {}

    def count(self, token: str) -> tuple[int, float]:
        """(tokens, forward score) of one pre-token; ties go to fewer tokens."""
        known = self.terminal.get(token)
        if known is not None:
            return known
        raw = token.encode("utf-8", "surrogatepass")
        if len(raw) > self.LONGEST:
            return self._alone(raw)
        if len(self.score) > self.MAX_NODES:
            self.clear()
        children, score, tokens, suffixes = self.children, self.score, self.tokens, self.suffixes
        path = [0]
        for i in range(1, len(raw) + 1):
            key = path[-1] << 8 | raw[i - 1]
            node = children.get(key)
            if node is None:
                best, least = score[path[-1]] + UNKNOWN, tokens[path[-1]] + 1
                for j in range(i - 1, -1, -1):
                    s = suffixes.get(raw[j:i], False)
                    if s is False:
                        break
                    if s is not None:
                        at = path[j]
                        got = score[at] + s
                        if got > best or got == best and tokens[at] + 1 < least:
                            best, least = got, tokens[at] + 1
                node = children[key] = len(score)
                score.append(best)
                tokens.append(least)
            path.append(node)
        known = self.terminal[token] = (tokens[path[-1]], score[path[-1]])
        return known


    def _alone(self, raw: bytes) -> tuple[int, float]:
        """:meth:`count` of one long pre-token; holds the forward scores of as many bytes as the longest piece has."""
        size = self.reach + 1
        score, tokens = [0.0] * size, [0] * size
        for i in range(1, len(raw) + 1):
            last = (i - 1) % size
            best, least = score[last] + UNKNOWN, tokens[last] + 1
            for j in range(i - 1, -1, -1):
                s = self.suffixes.get(raw[j:i], False)
                if s is False:
                    break
                if s is not None:
                    got = score[j % size] + s
                    if got > best or got == best and tokens[j % size] + 1 < least:
                        best, least = got, tokens[j % size] + 1
            score[i % size], tokens[i % size] = best, least
        return tokens[len(raw) % size], score[len(raw) % size]


_tries: dict[str, PrefixTrie] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score): one row for each row of ``docs``; null and empty texts have no tokens.

    Scores follow from the vocabulary's ranks alone, see :func:`load_vocabulary`; no text enters them. Repeated rows and
    null ids are counted one by one; extra columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    A very long text is held whole with its pre-tokens; the trie's size has a bound, whatever the texts.
    """
    import public_tokenizers

    vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import regex

        if vocabulary not in _tries:
            _tries[vocabulary] = PrefixTrie(load_vocabulary(vocabulary))
        trie, cut = _tries[vocabulary], regex.compile(pattern)
        for batch in batches:
            n_pre, n_tok, scores = [], [], []
            for text in batch.column("text").to_pylist():
                pre, tok, score = 0, 0, 0.0
                for token, n in Counter(cut.findall(text or "")).items():
                    k, s = trie.count(token)
                    pre, tok, score = pre + n, tok + n * k, score + n * s
                n_pre.append(pre)
                n_tok.append(tok)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
