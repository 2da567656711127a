"""Operator 8: token counts under a unigram model, by a trie of pre-tokens.

Texts are cut into pre-tokens at white space, each with the word-start mark of the
vocabulary. A task has one trie that grows by the distinct pre-tokens of its texts, batch
after batch. The forward (Viterbi) recurrence runs over new nodes alone: the best score and
token count of a prefix are computed once, however many pre-tokens share it and whenever they
come, and the counts at the terminal nodes are stored. A document's count is the sum over its
pre-tokens. Nothing is shuffled, and a task starts a new trie when the distinct
pre-tokens or the nodes at hand reach a bound, which changes no result. Pre-tokens of over
512 characters run the same recurrence alone. Pieces are found by hash and compared by character.

The vocabulary is a public one, given by path; its pieces are ordered by rank and
piece r has log probability -log((r + 1) * H), H making the sum one (a unigram
model with Zipf weights; no tokenizer is trained). A character outside the
vocabulary costs one token for each of its UTF-8 bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "piece_bpe_32k.model"
WORD_START = "▁"
#: Distinct pre-tokens that one trie holds at most.
TRIE_WORDS = 400_000
#: Nodes after which a task starts a new trie (some 150 bytes each).
TRIE_NODES = 1_500_000
#: Pre-tokens of more characters run by themselves: they hardly share prefixes, and the
#: recurrence over the trie takes its steps for all words at once.
LONG_WORD = 512
_BASE = np.uint64(0x100000001B3)
_UNKNOWN = -1e4


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, by rank, without controls and bytes."""
    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))]


def unigram_scores(pieces: list[str]) -> dict[str, float]:
    h = float(np.sum(1.0 / np.arange(1, len(pieces) + 1)))
    out: dict[str, float] = {}
    for r, piece in enumerate(pieces):
        out.setdefault(piece, -float(np.log((r + 1) * h)))
    return out


class TrieCounter:
    """Best-path token counts of strings by a trie that grows from call to call."""

    def __init__(self, scores: dict[str, float]):
        self.scores = {piece: s for piece, s in scores.items() if piece}
        by_length: dict[int, list[str]] = {}
        for piece in self.scores:
            by_length.setdefault(len(piece), []).append(piece)
        self.lengths = sorted(by_length)
        self.tables = {}
        for n, pieces in by_length.items():
            h = np.array([_hash_of(p) for p in pieces], np.uint64)
            order = np.argsort(h, kind="stable")
            chars = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            self.tables[n] = (h[order], np.array([self.scores[p] for p in pieces])[order], chars[order])
        self.forget()

    def forget(self) -> None:
        """Start a new trie."""
        #: of each node, the root first: best score, tokens and hash of its prefix; (parent, character) -> node
        self.best, self.tokens, self.hash = np.zeros(1 << 12), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64)
        self.nodes, self.child = 1, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, by the highest sum of scores, then by fewest tokens."""
        out = np.zeros(len(words), np.int64)
        lens = np.array([len(w) for w in words], np.int64)
        # long strings apart, so that the character matrix stays near the text's size; the trie is one
        edges = [0, 16, 64, LONG_WORD]
        for lo, hi in zip(edges, edges[1:]):
            at = np.flatnonzero((lens > lo) & (lens <= hi))
            step = max(1, (1 << 24) // max(1, int(lens[at].max()) if len(at) else 1))
            for a in range(0, len(at), step):
                part = at[a : a + step]
                out[part] = self._count([words[i] for i in part], lens[part])
        for i in np.flatnonzero(lens > LONG_WORD):
            out[i] = self._count_one(words[i])
        return out

    def _count_one(self, word: str) -> int:
        """The same recurrence over one word, without a trie."""
        scores, lengths = self.scores, self.lengths
        best, tokens = [0.0], [0]
        for d in range(1, len(word) + 1):
            n = len(word[d - 1].encode("utf-8", "surrogatepass"))
            top, count = best[d - 1] + _UNKNOWN * n, tokens[d - 1] + n
            for n in lengths:
                if n > d:
                    break
                s = scores.get(word[d - n : d])
                if s is None:
                    continue
                s += best[d - n]
                if s > top + 1e-9 or (abs(s - top) <= 1e-9 and tokens[d - n] + 1 < count):
                    top, count = s, tokens[d - n] + 1
            best.append(top)
            tokens.append(count)
        return tokens[-1]

    def _count(self, words: list[str], lens: np.ndarray) -> np.ndarray:
        """Walk the words down the trie together, by depth; only nodes that are new are scored.

        Words are sorted, so those of one prefix stand together: at depth d a node is a run of words.
        """
        width = int(lens.max())
        chars = np.zeros((len(words), width), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars[np.arange(width)[None, :] < lens[:, None]] = flat
        order = np.lexsort(chars.T[::-1]) if width <= 64 else np.array(sorted(range(len(words)), key=words.__getitem__))
        chars, sizes = chars[order], lens[order]
        back = max(self.lengths, default=1)
        path = [np.zeros(len(words), np.int64)]  # the node of each word at the last ``back`` depths, newest last
        terminal = np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        for d in range(1, width + 1):
            keep = sizes[live] >= d
            live, path = live[keep], [p[keep] for p in path]
            ch, parent = chars[live, d - 1].astype(np.int64), path[-1]
            run = np.ones(len(live), bool)
            run[1:] = (parent[1:] != parent[:-1]) | (ch[1:] != ch[:-1])
            first = np.flatnonzero(run)  # a word that stands for each node
            keys = (parent[first] << 21 | ch[first]).tolist()
            before = self.nodes
            at = np.array([self._node(k) for k in keys], np.int64)
            fresh = np.flatnonzero(at >= before)
            if len(fresh):
                self._score(at[fresh], [p[first[fresh]] for p in path], chars, live[first[fresh]], d)
            node = at[np.cumsum(run) - 1]
            ends = sizes[live] == d
            terminal[live[ends]] = self.tokens[node[ends]]
            path = [*path, node][-back:]
        out = np.empty(len(words), np.int64)
        out[order] = terminal
        return out

    def _node(self, key: int) -> int:
        """The node of (parent, character), made where there is none."""
        i = self.child.get(key)
        if i is None:
            i = self.child[key] = self.nodes
            self.nodes += 1
        return i

    def _score(self, node: np.ndarray, path: list[np.ndarray], chars: np.ndarray, word: np.ndarray, d: int) -> None:
        """Best score and tokens of new nodes at depth ``d``; ``path`` has their ancestors, ``word`` a word through each."""
        if self.nodes > len(self.best):
            more = max(self.nodes, 2 * len(self.best)) - len(self.best)
            self.best, self.tokens, self.hash = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.best, self.tokens, self.hash))
        ch = chars[word, d - 1]
        own_hash = self.hash[path[-1]] * _BASE + (ch.astype(np.uint64) + np.uint64(1))
        size = _utf8_bytes(ch)
        best, count = self.best[path[-1]] + _UNKNOWN * size, self.tokens[path[-1]] + size
        for n in self.lengths:
            if n > d:
                break
            h, s, pieces = self.tables[n]
            old = path[-n]
            own = own_hash - self.hash[old] * _power(n)
            at = np.minimum(np.searchsorted(h, own), len(h) - 1)
            hit = np.flatnonzero(h[at] == own)
            if len(hit):
                hit = hit[(chars[word[hit], d - n : d] == pieces[at[hit]]).all(axis=1)]
            if not len(hit):
                continue
            score, tokens = self.best[old[hit]] + s[at[hit]], self.tokens[old[hit]] + 1
            better = (score > best[hit] + 1e-9) | ((np.abs(score - best[hit]) <= 1e-9) & (tokens < count[hit]))
            best[hit[better]], count[hit[better]] = score[better], tokens[better]
        self.best[node], self.tokens[node], self.hash[node] = best, count, own_hash


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _hash_of(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _utf8_bytes(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def token_counts(docs: DataFrame, scores: dict[str, float], *, doc_id: str = "doc_id", text: str = "text", trie_words: int = TRIE_WORDS) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens): null and empty texts count zero.

    Repeated rows stay repeated; a null id is carried. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TrieCounter(model.value)
        ids: dict[str, int] = {}
        known = np.empty(0, np.int64)
        for b in batches:
            pretokens, n_tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            at, held = [], []  # documents whose words are counted together
            fresh: list[str] = []

            def settle() -> None:
                nonlocal known, at, held, fresh, ids
                if fresh:
                    known = np.concatenate([known, count(fresh)])
                for row, own in zip(at, held):
                    n_tokens[row] += int(known[own].sum()) if own else 0
                at, held, fresh = [], [], []
                if len(ids) > trie_words or count.nodes > TRIE_NODES:
                    ids, known = {}, np.empty(0, np.int64)
                    count.forget()

            for row, t in enumerate(b.column(1)):
                words = (t.as_py() or "").split()
                pretokens[row] = len(words)
                for a in range(0, len(words), trie_words):
                    own = []
                    for w in words[a : a + trie_words]:
                        i = ids.get(w)
                        if i is None:
                            i = ids[w] = len(ids)
                            fresh.append(WORD_START + w)
                        own.append(i)
                    at.append(row)
                    held.append(own)
                    if len(ids) > trie_words:
                        settle()
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pretokens), pa.array(n_tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), unigram_scores(load_pieces(f"{TOKENIZERS}/{VOCABULARY}")))
