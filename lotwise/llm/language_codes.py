"""Language identification by error-correcting output codes.

Every language gets a codeword; every bit of the codewords is a binary classifier over character n-grams (log-odds
of the languages with that bit set against the others). A text's bit scores are compared with all codewords by a
logistic loss, weighted by how reliable a bit is for a language, and the nearest codeword wins. A small gap to the
second nearest marks the text as ambiguous.

Training counts n-grams of all labelled rows, not of a sample: tasks count per language and bucket, Spark adds up,
and only languages x buckets numbers reach the driver.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotwise.llm.common import WordCache, filter_rows, id_and_text, share

BUCKETS = 1 << 14  # n-gram hash buckets
WORDS_AT_ONCE = 100_000  # different words whose n-grams are counted together in training
MAX_BITS = 63  # codeword length; fewer languages than 7 take every split there is
SMOOTHING = 0.5
EVIDENCE = 40  # words beyond which more of the same share of votes makes a text no surer
VOTE = 4.0  # most that one word can add to a bit
AMBIGUOUS = 0.1  # gap between the two best scores below which a text is flagged
UNDECIDED = "und"

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers of the n-gram hash


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word numbers) of the n-grams of 1 to 3 characters of all letter runs of the words, lower-cased.

    Runs are bounded by a mark that belongs to their first and last n-grams. Words hold no white space.
    """
    text = "\n" + "\n".join(words).lower() + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    kinds, at = np.unique(codes, return_inverse=True)
    letter = np.array([chr(int(k)).isalpha() for k in kinds])[at]
    word = np.cumsum(codes == 10) - 1
    codes = np.where(letter, codes, 0)
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])  # the mark before or after a run included
    owner = np.where(letter[two], word[two], word[two + 1])
    keys = [
        codes[one] * P1,
        codes[two] * P2 + codes[two + 1] * P1 + np.uint64(1),
        (codes[one - 1] * P2 + codes[one]) * P2 + codes[one + 1] * P1 + np.uint64(2),
    ]
    buckets = [((k * P2) >> np.uint64(32)) % np.uint64(BUCKETS) for k in keys]
    return np.concatenate(buckets).astype(np.int64), np.concatenate([word[one], owner, word[one]])


def has_letter(text: str | None) -> bool:
    return text is not None and next(filter(str.isalpha, text), None) is not None


def codewords(n: int) -> np.ndarray:
    """n x bits matrix of +1 and -1: every split of the languages, or MAX_BITS different ones drawn with a seed."""
    if n < 2:
        return np.ones((n, 0))
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        columns = [(1, *c) for c in product((1, -1), repeat=n - 1)][1:]
    else:
        rng, seen = np.random.default_rng(7), {}
        while len(seen) < MAX_BITS:
            c = rng.choice((1, -1), n)
            c = tuple((c * c[0]).tolist())
            if len(set(c)) == 2:
                seen[c] = None
        columns = list(seen)
    return np.array(columns, float).T


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log-odds
    trust: np.ndarray  # languages x bits, rows sum to the number of bits

    @classmethod
    def from_counts(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        languages = sorted(counts)
        code = codewords(len(languages))
        share = np.array([(counts[k] + SMOOTHING) / (counts[k].sum() + SMOOTHING * BUCKETS) for k in languages])
        weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
        trust = np.ones_like(code)
        for b in range(code.shape[1]):
            on = code[:, b] > 0
            weights[:, b] = np.log(share[on].mean(axis=0)) - np.log(share[~on].mean(axis=0))
            right = np.sign(weights[:, b])[None, :] == code[:, b][:, None]
            trust[:, b] = (share * right).sum(axis=1)
        if code.shape[1]:
            trust *= code.shape[1] / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
        return cls(languages, code, weights, trust)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Per word its vote on every bit, and 1 if it has a letter."""
        buckets, word = ngram_buckets(words)
        rows = np.zeros((len(words), self.code.shape[1] + 1), np.float32)
        rows[word, -1] = 1
        for b in range(self.code.shape[1]):
            rows[:, b] = np.clip(np.bincount(word, self.weights[buckets, b], len(words)), -VOTE, VOTE)
        return rows

    def decode(self, sums: np.ndarray) -> tuple[str, float, float]:
        """(language, score, gap to the second best score) from the sum of a text's word rows."""
        if len(self.languages) < 2:
            return (self.languages[0], 1.0, 1.0) if self.languages else (UNDECIDED, 0.0, 0.0)
        words = max(sums[-1], 1.0)
        bits = sums[:-1] / words * np.sqrt(min(words, EVIDENCE))
        loss = (self.trust * np.logaddexp(0.0, -self.code * bits)).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.languages[order[0]], float(p[order[0]]), float(p[order[0]] - p[order[1]])


def predictor(model: LanguageModel):
    """`predict(text) -> (language, score, gap)` with a cache of word rows."""
    width = model.code.shape[1] + 1
    cache = WordCache(lambda words: model.word_rows(words).view(f"V{4 * width}").ravel().tolist())

    def predict(text: str | None) -> tuple[str, float, float]:
        if not has_letter(text):
            return UNDECIDED, 0.0, 0.0
        words = text.split()
        rows = np.frombuffer(b"".join(map(cache.fetch(words).__getitem__, words)), np.float32).reshape(-1, width)
        return model.decode(rows.sum(axis=0, dtype=np.float64))

    return predict


def train_language_codes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Model from all rows with a language and a text; rows without either take no part."""

    def run(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        held = 0

        def flush():
            for lang, counter in words.items():
                if counter:
                    buckets, word = ngram_buckets(list(counter))
                    counts = np.fromiter(counter.values(), np.int64, len(counter))
                    totals[lang] += np.bincount(buckets, counts[word], BUCKETS).astype(np.int64)
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counter = words[lang]
                held -= len(counter)
                counter.update(text.as_py().split())
                held += len(counter)
                if held > WORDS_AT_ONCE:
                    flush()
                    held = 0
        flush()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.record_batch(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = labelled.select(
        labelled[lang_col].cast("string").alias("lang"), labelled[text_col].cast("string").alias("text")
    ).dropna()
    counted = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS))
    table = counted.toArrow()  # at most languages x BUCKETS rows
    for lang, bucket, n in zip(*(table.column(k).to_pylist() for k in ("lang", "bucket", "n"))):
        counts[lang][bucket] = n
    return LanguageModel.from_counts(dict(counts))


def predict_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous. `und` and score 0 for texts that are null or have no letter,
    and for every text if nothing was learned."""
    shared = share(docs.sparkSession, model, predictor)  # BUCKETS x at most MAX_BITS floats: under 5 MB

    def run(batches):
        predict = shared()
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[0] != UNDECIDED and f[2] < AMBIGUOUS for f in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean"
    )


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Rows of `docs` with a language; texts that are null or have no letter go. Ambiguous texts stay: a short or
    mixed text is not a bad one."""
    shared = share(docs.sparkSession, model, predictor)

    def judge():
        predict = shared()
        return lambda text: predict(text)[0] != UNDECIDED

    return filter_rows(docs, text_col, judge)
