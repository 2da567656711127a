"""Operator 5: toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: NFKC and lower case (accents stay, they tell words apart;
loose combining marks go), homoglyphs of other scripts to Latin letters, digits and signs that stand for letters to those letters
where they touch letters, zero-width marks removed, and everything that is not a
letter to one space. The automaton finds lexicon terms as whole words of the folded
text; terms inside an exception phrase do not count. The sum of the weights,
normalised by length, goes through a logistic curve.

The lexicon is learned: words and word stems (``stem*``, any ending) of a bounded,
documented sample of labelled texts, with their smoothed log odds of appearing in a
toxic text as weights. Of the terms that match one word, the heaviest counts. Documents are
read once for scoring, with the (bounded) model broadcast; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, labelled_sample, table

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁԛԝһкмтвнαβεηικνορτυχωγσ",
    "aeopcyxijsdqwhkmtbhabenikvoptuxwys",
)
#: Digits and signs read as letters when they touch a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
#: Harmless phrases that hold words often found in lexicons; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid simple", "idiot proof", "sore loser board")
#: A pair of words is an exception from so many clean texts, copies aside, with so many for each toxic one.
PHRASE_TEXTS, PHRASE_ODDS = 5, 3
SAMPLE_ROWS = 20_000
LEXICON_TERMS = 2_000
#: Letters of a stem; one that is a whole word also matches longer words.
STEM_LENGTHS = (3, 4, 5, 6, 7)

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_MARKS = re.compile("[\u0300-\u036f]")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """The folded form: lower-case letters with single spaces between words."""
    t = (text or "").lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKC", _HIDDEN.sub("", t))).lower().translate(HOMOGLYPHS)
    if _SPECIAL.search(t):
        t = _CHUNK.sub(_unmask, t)
    return _OTHER.sub(" ", t).strip()


_SPECIAL = re.compile(r"[0-9@$!|€£]")
_CHUNK = re.compile(r"[^\s]*[0-9@$!|€£][^\s]*")
_SUB = str.maketrans(SUBSTITUTES)


#: Word parts of a run without spaces: letters, digits and substitutes, which three signs in a row end.
_PART = re.compile(r"(?:[^\W_]|(?<![@$!|€£])[@$!|€£]{1,2}(?![@$!|€£]))+")
_TAIL = "@$!|€£"


def _readable(part: str) -> bool:
    letters = sum(c.isalpha() for c in part)
    return 0 < letters and sum(c.isdigit() for c in part) <= letters + 1


def _unmask(m: re.Match) -> str:
    """Read substitutes as letters in the parts of a run that have a letter.

    Signs at the end of a part are punctuation. Parts with more digits than letters
    stay, unless the run as a whole has letters enough.
    """
    run = _readable(m.group().rstrip("!|.,;:?$@€£#%&*\"')]}"))

    def one(p: re.Match) -> str:
        part = p.group().rstrip(_TAIL)
        if _readable(part) or (run and any(c.isalpha() for c in part)):
            return part.translate(_SUB) + " " * (len(p.group()) - len(part))
        return p.group()

    return _PART.sub(one, m.group())


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    by_sum: float = 1.0
    by_rate: float = 1.0
    automaton: object = field(default=None, repr=False)

    def build(self) -> Lexicon:
        self.automaton = ahocorasick.Automaton()
        patterns = {f" {t[:-1]}" if t.endswith("*") else f" {t} ": w for t, w in self.weights.items()}
        patterns |= {f" {fold(phrase)} ": None for phrase in self.exceptions}
        for pattern, w in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), w))
        self.automaton.make_automaton()
        return self

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """(sum of weights, number of matches, number of words) of a text."""
        folded = fold(text)
        words = folded.count(" ") + 1 if folded else 0
        if not words or not len(self.automaton):
            return 0.0, 0, words
        hits = self.hits(f" {folded} ")
        return float(sum(hits.values())), len(hits), words

    def hits(self, padded: str) -> dict[int, float]:
        """Weight by the place before the word, of words outside exception phrases."""
        hits: dict[int, float] = {}
        spared = []
        for end, (n, w) in self.automaton.iter(padded):
            at = end - n + 1  # of the space before the match
            if w is None:
                spared.append((at, end))
            else:
                hits[at] = max(w, hits.get(at, 0.0))
        if not spared:
            return hits
        out, covered, i = {}, -1, 0
        spared.sort()
        for at in sorted(hits):  # both in order; ``covered`` is the furthest end of the phrases that began
            while i < len(spared) and spared[i][0] <= at:
                covered = max(covered, spared[i][1])
                i += 1
            if at >= covered:
                out[at] = hits[at]
        return out

    def score(self, total: float, words: int) -> float:
        x = self.bias + self.by_sum * math.log1p(max(0.0, total)) + self.by_rate * math.log1p(max(0.0, 100.0 * total / max(1, words)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def _fold_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ys, ws = [], []
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = set(fold(t).split())
            words |= {f"{w[:k]}*" for w in words for k in STEM_LENGTHS if len(w) >= k}
            ws.extend(words)
            ys.extend([y] * len(words))
        yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(ys, pa.int32())], ["word", "y"])


def learn_lexicon(
    labelled: DataFrame,
    *,
    text: str = "text",
    label: str = "toxic",
    exceptions: tuple[str, ...] = EXCEPTIONS,
    terms: int = LEXICON_TERMS,
    least_texts: int = 5,
    least_odds: float = 2.5,
) -> Lexicon:
    """A lexicon from labelled rows (a bounded sample; the caller bounds it).

    A term enters with ``least_texts`` (and 0.4 %) of the toxic texts, copies aside, and smoothed log odds of at least
    ``least_odds``; at most ``terms``, by odds times the root of its toxic texts (rarer
    and weaker terms beyond that are not learned). Pairs of words around a term that
    are typical of clean texts become exceptions. No labels give an empty lexicon that
    scores every text below one half.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, exceptions).build()
    least_texts = max(least_texts, round(0.004 * n1))
    seen = rows.dropDuplicates(["t"]).mapInArrow(_fold_words, "word string, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    best = (
        seen.where(F.col("a") >= least_texts)
        .withColumn("w", odds)
        .where(F.col("w") >= least_odds)
        .where(F.col("b") <= 0.02 * F.col("a") * n0 / n1 + 1)
        .orderBy((F.col("w") * F.sqrt("a")).desc(), "word")
        .limit(terms)
        .collect()
    )
    lexicon = Lexicon({r["word"]: float(r["w"]) for r in best}, exceptions).build()
    phrases = rows.dropDuplicates(["t"]).mapInArrow(_phrases(lexicon), "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    learned = phrases.where((F.col("b") >= PHRASE_TEXTS) & (F.col("b") / n0 >= PHRASE_ODDS * (F.col("a") + 0.5) / n1))
    learned = learned.orderBy(F.col("b").desc(), "phrase").limit(terms).collect()
    lexicon = Lexicon(lexicon.weights, (*exceptions, *(r["phrase"] for r in learned))).build()
    measured = rows.mapInArrow(_measure(lexicon), "total double, words long, y int")
    m = np.array([tuple(r) for r in measured.collect()], float)  # bounded by the sample
    _fit(lexicon, m)
    return lexicon


def _phrases(lexicon: Lexicon):
    """Pairs of neighbouring words of which one is in the lexicon, each once a text."""
    model = (lexicon.weights, lexicon.exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*model).build()
        for b in batches:
            ys, ps = [], []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                padded = f" {fold(t)} "
                if padded == "  " or not len(own.automaton):
                    continue
                found = set()
                for at in own.hits(padded):
                    end = padded.index(" ", at + 1)
                    before = padded.rfind(" ", 0, at)
                    after = padded.find(" ", end + 1)
                    if before >= 0:
                        found.add(padded[before + 1 : end])
                    if after >= 0:
                        found.add(padded[at + 1 : after])
                ps.extend(found)
                ys.extend([y] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.string()), pa.array(ys, pa.int32())], ["phrase", "y"])

    return run


def _measure(lexicon: Lexicon):
    model = (lexicon.weights, lexicon.exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*model).build()
        for b in batches:
            got = [own.measure(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), b.column(1)], ["total", "words", "y"]
            )

    return run


def _fit(lexicon: Lexicon, m: np.ndarray) -> None:
    """Ridge logistic regression on log sum and log rate, by Newton steps."""
    x = np.stack([np.ones(len(m)), np.log1p(m[:, 0]), np.log1p(100 * m[:, 0] / np.maximum(1, m[:, 1]))], 1)
    y, beta = m[:, 2], np.zeros(3)
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    lexicon.bias, lexicon.by_sum, lexicon.by_rate = map(float, beta)


def score_texts(docs: DataFrame, lexicon: Lexicon, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_hits, n_words): null and empty texts score the model's base.

    Repeated rows stay repeated; a null id is carried. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.bias, lexicon.by_sum, lexicon.by_rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*model.value).build()
        for b in batches:
            got = [own.measure(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([own.score(total, words) for total, _, words in got], pa.float64()),
                    pa.array([g[1] for g in got], pa.int64()),
                    pa.array([g[2] for g in got], pa.int64()),
                ],
                ["doc_id", "score", "n_hits", "n_words"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_hits long, n_words long")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents; ids held out never train."""
    return labelled_sample(docs, labels, label, rows, seed=11)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn_lexicon(training_rows(docs, labels, "toxic"))
    scored = score_texts(docs, lexicon)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_words"
    )
