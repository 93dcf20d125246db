"""Language identification by word-first backoff.

A known word scores its per-language log frequency. An unseen word backs off to its character
n-grams, the longest first: each position takes the longest n-gram the model knows, at a discount
for every order it had to step down. A text's language is the one with the greatest sum; the score
is its posterior probability with equal priors.

The model is fitted on a bounded sample: of every language the SAMPLE labelled training rows of least
hash, fewer if there are so many languages that ROWS in all would not do (one of each at least), and of
those no more whole texts than have BYTES in all; words count in two rows at least. The model is
broadcast. Predictions read whole texts of all rows. A word is a letter with the letters and marks that
follow it.

Defined cases: null text, or text without a letter, is `und` with score 0; without any labelled row
every text is `und`; ties go to the lesser name; lang, source and doc_id are never read to predict.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, pieces, small, tidily

SAMPLE, ROWS, BYTES = 400, 25_600, 64 << 20
ORDERS = (4, 3, 2, 1)
#: Log discount for each order stepped down, and the additive smoothing.
STEP, ADD = math.log(0.4), 0.1
#: Unseen words whose scores a task keeps.
MEMO = 100_000
_WORD = re.compile(r"[^\W\d_]+")
#: Where Python's own class of word characters is not that of letters: marks, and numbers that are no digits.
_OTHER = regex.compile(r"[\p{M}\p{Nl}\p{No}]")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> Counter:
    low = (text or "").lower()
    return Counter((_WORD if low.isascii() or not _OTHER.search(low) else _LETTERS).findall(low))


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        counts, rows, grams = defaultdict(lambda: [0] * len(self.langs)), Counter(), {n: defaultdict(lambda: [0] * len(self.langs)) for n in ORDERS}
        for k, lang in enumerate(self.langs):
            for text in samples[lang]:
                for w, c in words(text).items():
                    counts[w][k] += c
                    rows[w] += 1
                    for n in ORDERS:
                        padded = f"<{w}>"
                        for i in range(len(padded) - n + 1):
                            grams[n][padded[i : i + n]][k] += c
        known = _logs({w: c for w, c in counts.items() if rows[w] > 1})
        self.words = {w: k for k, w in enumerate(known)}
        self.known = np.array(list(known.values())).reshape(len(known), len(self.langs))
        # one table of n-grams of all orders, with the discount for the steps down to each
        logs = {g: v + down * STEP for down, n in enumerate(ORDERS) for g, v in _logs(grams[n]).items()}
        self.grams = {g: k for k, g in enumerate(logs)}
        self.gram_logs = np.array(list(logs.values())).reshape(len(logs), len(self.langs))
        self.rows: _Rows | None = None

    def back_off(self, unseen: list[str]) -> np.ndarray:
        """Of each word the mean score of its n-grams: at each place the longest that is known."""
        get, flat, ends = self.grams.get, [], []
        for word in unseen:
            padded = f"<{word}>"
            for i in range(len(padded)):
                for n in ORDERS:
                    if (k := get(padded[i : i + n])) is not None:
                        flat.append(k)
                        break
            ends.append(len(flat))
        ends = np.array(ends)
        n = np.diff(ends, prepend=0)
        total = np.zeros((len(flat) + 1, len(self.langs)))
        np.cumsum(self.gram_logs[flat], axis=0, out=total[1:])
        return (total[ends] - total[ends - n]) / np.maximum(1, n)[:, None]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.langs:
            return "und", 0.0
        if self.rows is None:
            self.rows = _Rows(self)
        own, counts = list(found), np.fromiter(found.values(), float, len(found))
        scores = np.zeros(len(self.langs))
        for a in range(0, len(own), MEMO // 2):
            scores += counts[a : a + MEMO // 2] @ self.rows.scores(own[a : a + MEMO // 2])
        best = int(scores.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(scores - scores[best], -700, 0)).sum())


class _Rows(dict):
    """Words' rows in a table of log scores: the known ones first, then unseen ones as they come, up to MEMO."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.table = model, np.vstack([model.known, np.empty((MEMO, len(model.langs)))])

    def scores(self, own: list[str]) -> np.ndarray:
        if len(self) + len(own) > len(self.table):
            self.clear()
            self.update(self.model.words)
        if unseen := [w for w in own if w not in self]:
            first = len(self)
            self.table[first : first + len(unseen)] = self.model.back_off(unseen)
            self.update(zip(unseen, range(first, first + len(unseen)), strict=True))
        return self.table[np.fromiter(map(self.__getitem__, own), np.int64, len(own))]


def _logs(counts: dict[str, list[int]]) -> dict[str, np.ndarray]:
    if not counts:
        return {}
    m = np.array(list(counts.values()), float) + ADD
    return dict(zip(counts, np.log(m / m.sum(axis=0)), strict=True))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 4 == 2


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """lang, text of the rows the model is fitted on. Hot languages are cut down in every task first."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc, F.lit(4)) != 2))
    counts = checkpoint(rows.groupBy("lang").count())
    langs = counts.count()
    per_language, most = max(1, min(per_language, ROWS // max(1, langs))), BYTES // max(1, langs)
    # the least hashes of each language, by a bound that leaves a few times as many rows as are kept
    bound = small(counts).select(F.col("lang").alias("__l"), F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("count")).alias("bound"))
    own = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).join(bound, F.col("lang") == F.col("__l"))
    near = own.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.col("bound") + 1e-9)
    order = Window.partitionBy("lang").orderBy("h", "text")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    size = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("size", size).where((F.col("rank") == 1) | (F.col("size") <= most)).select("lang", "text")


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    by = defaultdict(list)
    for r in sample(docs, per_language).collect():  # bounded: ROWS rows, or one of each language, and BYTES
        by[r["lang"]].append(r["text"])
    return Model(by)


def identify(docs: DataFrame, per_language: int = SAMPLE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with the two named columns beside, or instead of, their own."""
    docs = docs.drop(*names)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(it):
        m = model.value
        for batch in pieces(it):
            found = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*columns, *names])

        m.rows = None  # the words met, which the broadcast model would keep

    return docs.mapInArrow(tidily(run), f"{schema}, {names[0]} string, {names[1]} double")


def digest(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text", "lang"))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return out.select("doc_id", (F.pmod(crc, F.lit(4)) == 2).alias("held_out"), "lang_pred", "score")


#: Below this posterior no language has a majority.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents of which one language can be told; und and documents without a majority go."""
    lang, score = fresh("__lang", docs), fresh("__score", docs)
    found = identify(docs, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select([f"`{c}`" for c in docs.columns])
