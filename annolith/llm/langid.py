"""Language identification by word frequency with character n-gram backoff.

A known word scores its log frequency in each language.  An unseen word is
scored by its longest character n-grams that are known, shorter ones only where
no longer one is.  A document's language has the largest sum.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import mapped, slices

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4


def bounded(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows of df, or all if it has fewer, by a hash of `keys`: the same in every run. Rows of equal keys are drawn together, and once."""
    n = df.count()
    return df if n <= rows else df.filter(F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(1_000_000)) < int(1_000_000 * rows / n)).dropDuplicates(list(keys))


class LanguageModel:
    """Log frequencies by word and by character n-gram, one column a language."""

    def __init__(self, counts: dict[str, dict[str, int]], smoothing: float = 0.5):
        """counts: of each language, the counts of its words."""
        self.langs = sorted(counts)
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs)))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(self.langs))) for _ in range(LONGEST + 1)]
        for j, lang in enumerate(self.langs):
            for w, n in counts[lang].items():
                words[w][j] += n
                marked = f"^{w}$"
                for k in range(1, LONGEST + 1):
                    for i in range(len(marked) - k + 1):
                        grams[k][marked[i : i + k]][j] += n
        self.words, self.word_scores = self.table(words, smoothing)
        self.grams, self.gram_scores = zip(*(self.table(g, smoothing) for g in grams), strict=True)

    def table(self, found: dict[str, np.ndarray], smoothing: float) -> tuple[dict[str, int], np.ndarray]:
        names = list(found)
        if not names:
            return {}, np.zeros((0, len(self.langs)), np.float32)
        m = np.array([found[x] for x in names])
        p = np.log((m + smoothing) / (m.sum(0) + smoothing * len(names)))
        return {x: i for i, x in enumerate(names)}, p.astype(np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that aren't known, one row a word."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        left = list(range(len(words)))
        for k in range(LONGEST, 0, -1):
            known = self.grams[k].get
            flat: list[int] = []
            sizes = []
            for i in left:
                marked = f"^{words[i]}$"
                got = [g for at in range(len(marked) - k + 1) if (g := known(marked[at : at + k])) is not None]
                flat += got
                sizes.append(len(got))
            n = np.array(sizes, np.int64)
            some = np.flatnonzero(n)
            if len(some):
                at = np.cumsum(n[some]) - n[some]
                out[np.array(left)[some]] = np.add.reduceat(self.gram_scores[k][np.array(flat)], at, axis=0) / n[some][:, None]
            left = [i for i, x in zip(left, sizes, strict=True) if not x]
            if not left:
                break
        return out


class Scorer:
    """Scores texts by a LanguageModel; keeps the scores of at most `most` unseen words."""

    def __init__(self, model: LanguageModel, most: int = 400_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.index = dict(self.model.words)
        self.scores = np.zeros((len(self.index) + self.most, len(self.model.langs)), np.float32)
        self.scores[: len(self.index)] = self.model.word_scores
        self.used = len(self.index)

    def text(self, text: str) -> np.ndarray | None:
        """Sums of scores by language; None if the text has no letter. Long texts are worked through in pieces."""
        low = text.lower()
        if len(low) <= 300_000:
            words = LETTERS.findall(low)
            return self.words(words) if words else None
        total, some, found = np.zeros(len(self.model.langs)), False, LETTERS.finditer(low)
        while words := [m[0] for m in islice(found, 50_000)]:
            some = True
            total += self.words(words)
        return total if some else None

    def words(self, words: list[str]) -> np.ndarray:
        at = list(map(self.index.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None))
            if self.used + len(new) > len(self.scores):
                self.clear()
                return self.words(words)
            self.scores[self.used : self.used + len(new)] = self.model.unseen(new)
            self.index.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            at = list(map(self.index.__getitem__, words))
        return self.scores[np.array(at)].sum(0, dtype=np.float64)


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) of lower-cased words of letters."""

    def make():
        def run(batch):
            found: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[lang].update(LETTERS.findall(text.lower()))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"]) if rows else None

        return run

    return mapped(docs.select(text_col, lang_col), make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 4_000) -> LanguageModel:
    """Learn from about `sample_rows` labelled rows: every word of their whole texts, in every language they have. The sample is what bounds the model, which goes to the driver and to the executors.

    Rows without a text or a language aren't learned from; rows that repeat an id and a text count once in a sample; without any there is a model of no language."""
    rows = bounded(labelled.select(id_col, text_col, lang_col).dropna(subset=[lang_col, text_col]), sample_rows, id_col, text_col, lang_col)
    found: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, word, n in word_counts(rows, text_col, lang_col).orderBy("lang", "word").toLocalIterator():
        found[lang][word] = n
    return LanguageModel(found)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 0.5) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, from its words alone.

    score: the language's posterior, of log scores times `sharpness`, from 0 to 1. A null text, one without a letter,
    and any text if no language was learned have `und` and score 0. Ties go to the first language by name. Repeated
    rows are repeated; an empty table gives an empty result; other columns are ignored."""

    def make():
        scorer = Scorer(model) if model.langs else None

        def run(batch):
            preds, scores = [], []
            for text in batch.column(1):
                x = text.as_py()
                total = scorer.text(x) if x and scorer else None
                if total is None:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                best = int(total.argmax())
                preds.append(model.langs[best])
                scores.append(float(1 / np.exp((total - total[best]) * sharpness).sum()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

        return run

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, lang_pred string, score double")


def held_out(id_col: str, parts: int, part: int):
    """Whether the id's CRC-32, taken as text, has this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose language can't be told: no letter, or a score under `least`."""

    def run(batches):
        scorer = Scorer(model) if model.langs else None
        for batch in slices(batches):
            keep = []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                x = text.as_py()
                total = scorer.text(x) if x and scorer else None
                keep.append(total is not None and 1 / np.exp((total - total.max()) * 0.5).sum() >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
