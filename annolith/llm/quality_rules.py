"""Quality rules: word statistics, and perplexity bands of a modified Kneser-Ney model.

The model is over byte n-grams of whole texts, one distribution a language.
Spark counts the longest n-grams of the whole corpus and derives from them, in
joins, the continuation counts, the discounts by count class and the
probabilities of every order.  Scoring reads them from sorted arrays, one of
probabilities and one of back-off weights an order, with every n-gram counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import mapped, slices, stage
from .textkit import Hasher, Words, byte_table, mix, runs, shingles, utf8, within

ORDER = 5
#: Languages with a model and bands of their own, the most frequent: what a key of an n-gram has room for. What is broadcast has at most a row for each.
MOST_LANGS = 65_535
#: The characters that n_symbols counts.
SYMBOLS = b"#*$%&|<>"


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each position on, as one number with the first byte highest."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = data.astype(np.uint64)
    out = wide[:n].copy()
    for j in range(1, k):
        out <<= np.uint64(8)
        out |= wide[j : j + n]
    return out


def keys_of(gram: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
    """Each n-gram with its language's key (one for all, or one each) above it: nothing is hashed, so none collide."""
    return gram | np.asarray(lang, np.uint64) << np.uint64(8 * ORDER)


def lang_keys(langs: list[str]) -> dict[str, int]:
    """The key of each language, no two alike; 0 is for no language."""
    return {"": 0} | {x: i for i, x in enumerate(sorted(set(langs) - {""}), 1)}


def frequent_languages(docs: DataFrame, lang_col: str) -> list[str]:
    top = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    return [r.lang for r in top.collect()]


def language(lang_col: str, langs: list[str]):
    """A document's language if it is one of langs, else the empty string, as for null."""
    return F.when(F.col(lang_col).cast("string").isin(langs), F.col(lang_col).cast("string")).otherwise("") if langs else F.lit("")


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, g, n): counts of all ORDER-grams of all texts by language, combined in each task before they are shuffled."""

    def run(batches):
        held: dict[str, list] = {}
        many = 0

        def merged(parts):
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[new], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], new)

        def rows():
            for lang, parts in held.items():
                k, n = merged(parts)
                for at in range(0, len(k), 1 << 17):
                    piece = slice(at, at + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k[piece]), pa.string()), pa.array(k[piece].view(np.int64)), pa.array(n[piece])], ["lang", "g", "n"])

        for batch in slices(batches, 16 << 20):
            langs = pc.fill_null(batch.column(1), "")
            for lang in pc.unique(langs).to_pylist():
                raw, off = utf8(batch.column(0).filter(pc.equal(langs, lang)))
                for lo, hi in runs(off, 1 << 22):
                    data = raw[off[lo] : off[hi]]
                    if len(data) < ORDER:
                        continue
                    g = grams(data, ORDER)
                    edges = off[lo + 1 : hi] - off[lo]
                    if len(edges):  # n-grams that reach over the end of a text
                        over = (edges[:, None] - np.arange(1, ORDER)).ravel()
                        ok = np.ones(len(g), bool)
                        ok[over[(over >= 0) & (over < len(g))]] = False
                        g = g[ok]
                    if not len(g):
                        continue
                    g.sort()
                    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                    held.setdefault(lang, []).append((g[new], np.diff(np.append(new, len(g)))))
                    many += len(new)
                    if many > 8_000_000:
                        held = {x: [merged(p)] for x, p in held.items()}
                        many = sum(len(p[0][0]) for p in held.values())
                        if many > 6_000_000:
                            yield from rows()
                            held, many = {}, 0
        yield from rows()

    return docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("c"))


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 on: (lang, g, c, p) and (lang, ctx, c, gamma), by modified Kneser-Ney smoothing.

    counts: (lang, g, c) of the highest order. Below it a count is the number of different bytes that precede."""
    by_order = {ORDER: stage(counts)}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = stage(by_order[k + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count("*").alias("c")))
    out, lower = [], None
    for k in range(1, ORDER + 1):
        t = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
        d = by_order[k].groupBy("lang").agg(*t)
        y = F.coalesce(F.try_divide("t1", F.col("t1") + 2 * F.col("t2")), F.lit(0.5))
        cut = lambda i, a, b: F.greatest(F.lit(0.1 * i), F.least(F.lit(float(i)), F.coalesce(i - (i + 1) * y * F.try_divide(b, a), F.lit(0.5 * i)))).alias(f"d{i}")  # noqa: B023, E731
        d = d.select("lang", cut(1, "t1", "t2"), cut(2, "t2", "t3"), cut(3, "t3", "t4"))
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams_k = by_order[k].join(F.broadcast(d), "lang").withColumn("less", F.least(less, F.col("c"))).drop("d1", "d2", "d3").withColumn("ctx", F.shiftright("g", 8))
        ctx = grams_k.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("less") / F.sum("c")).alias("gamma"))
        p = grams_k.join(ctx, ["lang", "ctx"])
        if lower is None:
            p = p.withColumn("below", F.lit(1 / 256))
        else:
            p = p.withColumn("sub", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower.select("lang", F.col("g").alias("sub"), F.col("p").alias("below")), ["lang", "sub"])
        p = stage(p.select("lang", "g", "c", ((F.col("c") - F.col("less")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")))
        out.append((p, ctx.select("lang", "ctx", F.col("total").alias("c"), "gamma")))
        lower = p
    return out


def sorted_array(df: DataFrame, key: str, value: str, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, logs) of every n-gram, sorted by key: 12 bytes of driver and worker memory each."""

    def make():
        def run(batch):
            langs = np.array([names[x] for x in batch.column(0).to_pylist()], np.uint64)
            keys = keys_of(batch.column(1).to_numpy().view(np.uint64), langs)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.log(batch.column(2).to_numpy()).astype(np.float32))], ["h", "v"])

        return run

    rows = mapped(df.select("lang", key, value), make, "h long, v float").toArrow()
    h, v = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], v[order]


class HashModel:
    """Log probabilities and back-off weights in sorted arrays."""

    def __init__(self, p: list, gamma: list, langs: list[str]):
        self.p, self.gamma, self.langs, self.keys = p, gamma, langs, lang_keys(langs)

    @staticmethod
    def find(arrays, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is in the array, and its value if so. In order of the hashes, so that the search walks through memory once."""
        keys, values = arrays
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.searchsorted(keys, h[order])
        at[at == len(keys)] = 0
        return keys[at] == h, values[at]

    def log_probs(self, data: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
        """Natural log of the probability of each byte after the ORDER - 1 before it. lang: the language's key, for all or for each position."""
        g = grams(data, ORDER)
        lang = np.broadcast_to(np.asarray(lang, np.uint64), len(g))
        out = np.zeros(len(g), np.float32)
        left = np.arange(len(g))
        for k in range(ORDER, 0, -1):
            of, sub = lang[left], g[left] & np.uint64((1 << 8 * k) - 1)
            hit, v = self.find(self.p[k - 1], keys_of(sub, of))
            out[left[hit]] += v[hit]
            left, sub, of = left[~hit], sub[~hit], of[~hit]
            if not len(left):
                break
            hit, v = self.find(self.gamma[k - 1], keys_of(sub >> np.uint64(8), of))
            out[left[hit]] += v[hit]
        else:
            out[left] += np.float32(np.log(1 / 256))
        return out

    def text_bits(self, data: np.ndarray, off: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits, bytes) of each text of a run: the sum of -log2 probabilities and how many bytes it is over. Works through SLICE bytes at a time."""
        n = len(off) - 1
        bits = np.zeros(n)
        counts = np.maximum(np.diff(off) - ORDER + 1, 0)
        for lo in range(0, max(len(data) - ORDER + 1, 0), SLICE):
            part = data[lo : lo + SLICE + ORDER - 1]
            at = np.arange(lo, lo + len(part) - ORDER + 1)
            row = np.searchsorted(off, at, "right") - 1
            p = self.log_probs(part, langs[row])
            p[at + ORDER > off[row + 1]] = 0  # reaches into the next text
            bits -= np.bincount(row, weights=p, minlength=n)
        return bits / np.log(2), counts


SLICE = 1 << 19


def fit_kneser_ney(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> HashModel:
    langs = frequent_languages(docs, lang_col)
    tables = kneser_ney(gram_counts(docs.select(text_col, language(lang_col, langs).alias("_lang")), text_col, "_lang"))
    names = lang_keys(langs)
    return HashModel([sorted_array(p, "g", "p", names) for p, _ in tables], [sorted_array(c, "ctx", "gamma", names) for _, c in tables], langs)


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def base_statistics(raw: np.ndarray, off: np.ndarray, words: Words, h: np.ndarray, hasher: Hasher, symbol: np.ndarray) -> list[np.ndarray]:
    """The five base statistics of each row of a run."""
    lead = (words.data != 0) & ((raw & 0xC0) != 0x80)
    n = len(off) - 1
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    covered = np.zeros(len(h) + 1, np.int64)
    three, ok = shingles(h, 3), within(words.row, 3)
    at = np.flatnonzero(ok)
    again = at[twice(three[at] ^ salt[words.row[at]])]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + 3, -1)
    inside = np.cumsum(covered[:-1]) > 0
    cuts = np.flatnonzero(raw == 10)
    begins = np.union1d(off[:-1][np.diff(off) > 0], cuts + 1)
    begins = begins[begins < len(raw)]
    ends = np.append(begins[1:], len(raw))
    closed = raw[ends - 1] == 10
    ends = ends - closed
    first = np.searchsorted(words.starts, begins)
    filled = (first < len(words.starts)) & (words.starts[np.minimum(first, len(words.starts) - 1)] < ends) if len(words.starts) else np.zeros(len(begins), bool)
    begins, ends = begins[filled], ends[filled]
    row = np.searchsorted(off, begins, "right") - 1
    keys = hasher.spans(raw, begins, ends) ^ salt[row]
    _, firsts = np.unique(keys, return_index=True)
    dup = np.bincount(row, minlength=n) - np.bincount(row[firsts], minlength=n)
    return [np.diff(words.first), per_row(lead, off), per_row(symbol[raw], off), dup, per_row(inside, words.first)]


def score_quality(docs: DataFrame, model: HashModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, base statistics, byte_bits, word_bits): the log2 perplexity of the whole text by byte and by word, null for texts shorter than the model's order or without words."""

    def make():
        hasher, table, symbol = Hasher(), byte_table(False), np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True

        def run(batch):
            raw, off = utf8(batch.column(1))
            langs = batch.column(2).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for lo, hi in runs(off):
                data, o = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                words = Words(data, o, table)
                h = hasher.spans(words.data, words.starts, words.ends)
                for x, y in zip(out, base_statistics(data, o, words, h, hasher, symbol), strict=False):
                    x.append(y)
                total, count = model.text_bits(data, o, np.array([model.keys[x] for x in langs[lo:hi]], np.uint64))
                byte_bits = np.divide(total, count, out=np.full(hi - lo, np.nan), where=count > 0)
                n_words = np.diff(words.first)
                word_bits = np.divide(total, n_words, out=np.full(hi - lo, np.nan), where=(count > 0) & (n_words > 0))
                out[5].append(byte_bits)
                out[6].append(word_bits)
            cols = [pa.array(np.concatenate(x)).cast(pa.int64()) for x in out[:5]] + [pa.array(np.concatenate(x), from_pandas=True) for x in out[5:]]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "byte_bits", "word_bits"])

        return run

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), language(lang_col, model.langs).alias("lang")), make, f"doc_id long, lang string, {BASE}, byte_bits double, word_bits double")


def quality_rules(docs: DataFrame, model: HashModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", byte_band: tuple[float, float] = (7.0, 7.0), word_band: tuple[float, float] = (6.0, 6.0)) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the perplexities with their places in the bands).

    A document fails the base rules with under 50 words or with over half its words in repeated 3-word windows. Of the
    others, one is kept if both its log perplexities, by byte and by word, lie in its language's bands. A mean over a
    text varies less the longer the text is, so a text's place in a band is its distance from the language's median
    times the root of its words, in units of the quartile distance of such values on that side; the bands' lower and
    upper ends are so many units off. A null text has no words, a null language is one of its own; repeated rows are
    repeated; an empty table gives an empty result; other columns are ignored."""
    model = model or fit_kneser_ney(docs, text_col, lang_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stage(score_quality(docs, model, id_col, text_col, lang_col).withColumn("base_failed", failed))
    good = scored.filter("not base_failed")
    kinds = ("byte", "word")
    mid = good.groupBy(F.col("lang").alias("of")).agg(*[F.percentile_approx(f"{k}_bits", 0.5, 10_000).alias(f"{k}_mid") for k in kinds])
    off = lambda d: d.join(F.broadcast(mid), F.col("lang") == F.col("of"), "left").drop("of").withColumns({f"{k}_off": (F.col(f"{k}_bits") - F.col(f"{k}_mid")) * F.sqrt("n_words") for k in kinds})
    spread = off(good).groupBy(F.col("lang").alias("of")).agg(*[F.percentile_approx(f"{k}_off", [0.25, 0.75], 10_000).alias(f"{k}_q") for k in kinds])
    placed = off(scored).join(F.broadcast(spread), F.col("lang") == F.col("of"), "left")
    unit = {k: F.when(F.col(f"{k}_off") < 0, -F.col(f"{k}_q")[0]).otherwise(F.col(f"{k}_q")[1]) for k in kinds}
    place = {k: F.col(f"{k}_off") / F.greatest(unit[k], F.lit(0.2)) for k in kinds}
    inside = [place[k].between(-low, high) for k, (low, high) in zip(kinds, (byte_band, word_band), strict=True)]
    kept = ~F.col("base_failed") & F.coalesce(inside[0] & inside[1], F.lit(False))
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "byte_bits", place["byte"].alias("byte_place"), "word_bits", place["word"].alias("word_place"))
