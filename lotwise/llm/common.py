"""Helpers that several operators of this folder share."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CACHE_BYTES = 120_000_000  # of the words a worker remembers in one cache
LONGEST = 64  # characters of a word that is remembered; text without blanks makes words of any length
WORD_BYTES = 190  # of a word and what is kept for it, beside their own characters and bytes


def share(spark: SparkSession, value, make: Callable = lambda value: value) -> Callable:
    """Broadcast of a model or word list whose size the caller has bounded; called in a task, the result gives
    `make(value)`.

    The value travels with its classes, so workers need no copy of this package. What `make` returns lives as long as
    the worker process uses the broadcast, so a cache inside it serves all tasks of that process.
    """
    held = spark.sparkContext.broadcast({"data": cloudpickle.dumps(value)})

    def get():
        here = held.value
        if "made" not in here:
            here["made"] = make(pickle.loads(here["data"]))
        return here["made"]

    return get


class WordCache:
    """What a worker worked out for each word, within CACHE_BYTES. When half of that is new, what was older and not met
    since goes. Long words are worked out anew for every text."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], budget: int = CACHE_BYTES):
        self.make, self.half = make, budget // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size, self.passing = 0, []

    def fetch(self, words: list[str]) -> dict[str, bytes]:
        """A mapping with an entry for each of the words at least; it holds until the next call."""
        for word in self.passing:
            del self.young[word]
        self.passing = []
        if self.size > self.half:
            self.young, self.old, self.size = {}, self.young, 0
        missing = []
        for word in set(words).difference(self.young):
            value = self.old.get(word)
            if value is None:
                missing.append(word)
            else:
                self._put(word, value)
        if missing:
            for word, value in zip(missing, self.make(missing)):
                self._put(word, value)
        return self.young

    def _put(self, word: str, value: bytes) -> None:
        self.young[word] = value
        if len(word) > LONGEST:
            self.passing.append(word)
        else:
            self.size += WORD_BYTES + len(word) + len(value)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two named columns, under plain names, whatever else the table carries."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def filter_rows(docs: DataFrame, text_col: str, judge: Callable) -> DataFrame:
    """Rows for which `judge()(text)` holds; all columns pass through unchanged."""
    place = docs.columns.index(text_col)

    def run(batches):
        keeps = judge()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([keeps(v.as_py()) for v in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
