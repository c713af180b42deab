"""Token counts by trie-shared dynamic programming (operator 8)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read_table

VOCABULARY = "piece_bpe_32k.model"
#: Stands for the space before a word.
MARK = "▁"
#: New words and texts after which the words gathered are put in one trie.
TRIE_WORDS, TRIE_TEXTS = 40_000, 1_000
#: Counted words that a worker remembers, twice.
WORDS_KEPT = 400_000

_FOLD = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


class Unigram:
    """Pieces of a vocabulary with log-probabilities that fall with the piece's rank (Zipf's law).

    An automaton finds the pieces that end at a character: a state is the longest
    suffix so far that begins a piece, and `ends` lists (length, log-probability) of the pieces that end there.
    """

    def __init__(self, pieces: list[str], byte_cost: float | None = None):
        total = sum(1 / (r + 1) for r in range(len(pieces)))
        #: A character that no piece ends with is spelt in bytes, each a token at this cost.
        self.byte_cost = byte_cost if byte_cost is not None else -math.log((len(pieces) + 1) * total)
        self.next: list[dict[str, int]] = [{}]
        own: list[tuple | None] = [None]
        for r, piece in enumerate(pieces):
            s = 0
            for c in piece:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    own.append(None)
                s = self.next[s][c]
            # The first of equal pieces stands.
            own[s] = own[s] or (len(piece), -math.log((r + 1) * total))
        self.back = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, float], ...]] = [()] * len(self.next)
        level = [0]
        while level:
            following = []
            for s in level:
                for c, t in self.next[s].items():
                    if s:
                        up = self.back[s]
                        while up and c not in self.next[up]:
                            up = self.back[up]
                        self.back[t] = self.next[up].get(c, 0)
                    self.ends[t] = ((own[t],) if own[t] else ()) + self.ends[self.back[t]]
                    following.append(t)
            level = following
        #: Moves found so far, whether along a piece or back to a shorter suffix.
        self.moves: list[dict[str, int]] = [{} for _ in self.next]

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))])

    def move(self, state: int, c: str) -> int:
        s = state
        while s and c not in self.next[s]:
            s = self.back[s]
        out = self.next[s].get(c, 0)
        if len(self.moves[state]) < 512:
            self.moves[state][c] = out
        return out

    def forward(self, words: list[str]) -> Iterator[tuple[str, int, float]]:
        """(word, tokens, score) of the best segmentation of every distinct word; of equal ones, that of fewest tokens.

        The words are put in a trie and walked depth first, which is their sorted order: scores of a shared prefix are
        computed once and stand on the path until the walk leaves it.
        """
        states, scores, counts = [0], [0.0], [0]
        moves, ends, move, byte_cost = self.moves, self.ends, self.move, self.byte_cost
        path = ""
        for word in sorted(words):
            text = MARK + word
            k, n = 0, min(len(path), len(text))
            while k < n and path[k] == text[k]:
                k += 1
            del states[k + 1 :], scores[k + 1 :], counts[k + 1 :]
            for c in text[k:] if k else text:
                s = states[-1]
                t = moves[s].get(c)
                if t is None:
                    t = move(s, c)
                width = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                best, count = scores[-1] + width * byte_cost, counts[-1] + width
                for length, cost in ends[t]:
                    own = scores[-length] + cost
                    if own > best:
                        best, count = own, counts[-length] + 1
                    elif own == best and counts[-length] < count:
                        count = counts[-length] + 1
                states.append(t)
                scores.append(best)
                counts.append(count)
            path = text
            yield word, counts[-1], scores[-1]


class Counter(dict):
    """(tokens, score) by word; the new words of a group of texts share one trie."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.model, self.older = model, {}

    def learn(self, words: set[str]) -> None:
        for w in [w for w in words if w in self.older]:
            self[w] = self.older[w]
            words.discard(w)
        for word, tokens, score in self.model.forward(list(words)):
            self[word] = (tokens, score)

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int], list[float]]:
        n_words, n_tokens, scores = [], [], []
        group: list[list[str]] = []
        new: set[str] = set()

        def close() -> None:
            self.learn(new)
            for words in group:
                found = list(map(self.__getitem__, words))
                n_words.append(len(words))
                n_tokens.append(sum(x[0] for x in found))
                scores.append(math.fsum(x[1] for x in found))
            group.clear()
            new.clear()
            if len(self) > WORDS_KEPT:
                self.older = dict(self)
                self.clear()

        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass").split(" ")
            words = [w for w in words if w]
            new.update(w for w in words if w not in self)
            group.append(words)
            if len(new) >= TRIE_WORDS or len(group) >= TRIE_TEXTS:
                close()
        close()
        return n_words, n_tokens, scores


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """One counter, with the words that it remembers, for all tasks of a worker."""
    return Counter(Unigram.from_file(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and log_prob (6 decimals) of every whole text.

    Pre-tokens are words of what is not ASCII white space, with the vocabulary's space mark before them; a
    pre-token's tokens are its best segmentation under the unigram model. Nothing is shuffled: a worker inserts the
    words that it has not met in a trie. Null and empty texts have 0 tokens; repeated rows and
    null ids are counted like others; an empty table gives an empty result; other columns are ignored.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in pieces(batches, TRIE_TEXTS):
            n_words, n_tokens, scores = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([round(x, 6) for x in scores], pa.float64())],
                names=["doc_id", "n_words", "n_tokens", "log_prob"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_prob double")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
