"""Each operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annolith.llm import chaining, chat, decontaminate, html_extract, langid, line_dedup, mil, mixing, quality_rules, queries, simhash_dedup
from annolith.llm.decontaminate import word_hashes
from annolith.llm.textkit import Hasher, byte_table

from .helpers import EDGE, Union, documents, levenshtein, prose

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def test_language_id_held_out(spark, sf):
    got = queries.op1_language_id(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_language_model_backs_off_to_shorter_grams():
    m = langid.LanguageModel({"a": {"hallo": 5, "welt": 3}, "b": {"bonjour": 4, "monde": 2}})
    seen = m.unseen(["hallos", "onjou", "zz"])
    assert seen[0].argmax() == 0 and seen[1].argmax() == 1
    # of an alphabet that no word has, the ends of the word alone are known
    assert np.allclose(seen[2], m.gram_scores[1][[m.grams[1]["^"], m.grams[1]["$"]]].mean(0))


def test_language_id_edges(spark, edge, nothing):
    model = langid.fit_language_model(edge)
    by = {r.doc_id: r for r in langid.identify(edge.withColumn("lang_pred", F.lit(1)), model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and by[1].score == 0
    assert by[5].lang_pred == by[9].lang_pred == "en" and 0 <= by[5].score <= 1
    assert langid.identify(edge, model).count() == len(EDGE)
    none = langid.fit_language_model(nothing)
    assert {r.lang_pred for r in langid.identify(edge, none).collect()} == {"und"}
    assert langid.identify(nothing, none).count() == 0 and langid.keep_identified(nothing, model).count() == 0
    assert {r.doc_id for r in langid.keep_identified(edge, model).collect()} == {5, 6, 7, None, 8, 9, 10}


def brute_language(texts, langs, text, smoothing=0.5):
    """Scores of a text by the definition: a known word's log frequency, else the mean of its longest known n-grams'."""
    names = sorted({x for x in langs if x})
    words = {x: Counter() for x in names}
    for t, x in zip(texts, langs, strict=True):
        if t and x:
            words[x].update(re.findall(r"[^\W\d_]+", t.lower()))
    grams = [{x: Counter() for x in names} for _ in range(5)]
    for x in names:
        for w, n in words[x].items():
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    grams[k][x][f"^{w}$"[i : i + k]] += n

    def score(table, item, x):
        kinds = len({y for c in table.values() for y in c})
        return np.log((table[x][item] + smoothing) / (sum(table[x].values()) + smoothing * kinds))

    total = dict.fromkeys(names, 0.0)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for k in (0, 4, 3, 2, 1):
            parts = [w] if k == 0 else [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
            table = words if k == 0 else grams[k]
            parts = [p for p in parts if any(table[x][p] for x in names)]
            if parts:
                for x in names:
                    total[x] += np.mean([score(table, p, x) for p in parts])
                break
    best = max(names, key=lambda x: total[x])
    return best, 1 / sum(np.exp((total[x] - total[best]) * 0.5) for x in names)


def test_language_id_against_the_definition(spark):
    langs = [f"l{i:03}" for i in range(260)]  # more than a model once had room for
    rows = [(i, f"{prose(i, 4)} {x}wort {'lang' * 20}{x}", x) for i, x in enumerate(langs)] + [(900, prose(1, 5), None), (901, None, "l001"), (902, prose(2, 5), "l002"), (902, prose(2, 5), "l002")]
    docs = documents(spark, rows)
    asked = [(1, f"{prose(7, 3)} l007wort"), (2, "thetheing zzz l259"), (3, "l259wort l259wort"), (4, "ofqua bra " + "lang" * 20 + "l123")]
    got = {r.doc_id: r for r in langid.identify(documents(spark, asked), langid.fit_language_model(docs)).collect()}
    for d, text in asked:
        lang, p = brute_language([r[1] for r in rows], [r[2] for r in rows], text)
        assert got[d].lang_pred == lang and got[d].score == pytest.approx(p, rel=1e-3)


def test_samples_are_bounded_where_an_id_repeats(spark):
    rows = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    assert 300 < langid.bounded(rows, 500, "doc_id", "text").count() < 800
    assert langid.bounded(rows.withColumn("text", F.lit("same")), 500, "doc_id", "text").count() <= 1


# 2


def brute_lines(rows, least=0.8):
    """(doc, line) that go, by comparing all pairs of lines."""
    import pyarrow as pa

    from annolith.llm.textkit import Hasher

    texts = [t or "" for _, t in rows]
    table, hasher, found = line_dedup.normal_table(), Hasher(), []
    for lo, x in line_dedup.line_runs(pa.array(texts), hasher, table):
        prints = line_dedup.odd_majority(*x.features(np.arange(len(x.key))))
        for i in range(len(x.key)):
            found.append(((rows[lo + x.row[i]][0], int(x.number[i])), x.normal(i), int(prints[i])))
    u = Union([f[0] for f in found])
    for i, a in enumerate(found):
        for b in found[:i]:
            if a[1] == b[1] or (bin(a[2] ^ b[2]).count("1") <= line_dedup.RADIUS and levenshtein(a[1], b[1]) <= (1 - least) * max(len(a[1]), len(b[1])) + 1e-9):
                u.join(a[0], b[0])
    return {f[0] for f in found if u.find(f[0]) != f[0]}


def test_line_dedup_brute_force(spark, monkeypatch):
    r, rows = random.Random(9), []
    base = [prose(100 + i, 30) for i in range(12)]
    for d in range(40):
        lines = []
        for _ in range(4):
            w = r.choice(base).split()
            for _ in range(r.choice((0, 0, 1, 2))):
                w[r.randrange(len(w))] = r.choice(("and", "XYZW", "tion"))
            lines.append(r.choice((" ".join(w), " ".join(w).upper(), " ".join(w) + "!!", prose(r.random(), 6), "ok")))
        rows.append((d, "\n".join(lines)))
    gone = brute_lines(rows)
    assert len(gone) > 40
    for chunk in (4096, 5):  # with all keys whole, and with most of them dealt out in chunks
        monkeypatch.setattr(line_dedup, "CHUNK", chunk)
        got = {x.doc_id: x for x in line_dedup.dedup_lines(documents(spark, rows)).collect()}
        for d, text in rows:
            keep = [line for i, line in enumerate(text.split("\n")) if (d, i) not in gone]
            assert got[d].text == "\n".join(keep)
            assert (got[d].n_lines, got[d].n_removed) == (4, 4 - len(keep))


def test_line_dedup_recall_without_the_fingerprint(spark):
    r, rows, groups = random.Random(21), [], 0
    for n in (3, 5, 9, 20, 40):
        for k in range(40):
            a = prose(f"{n} {k}", n).split()
            b = list(a)
            for i in r.sample(range(n), max(1, n // 10)):
                b[i] = b[i][:-1] + "q" if n < 9 else prose(r.random(), 1)
            x, y = " ".join(a), " ".join(b)
            if levenshtein(x.encode(), y.encode()) <= 0.2 * max(len(x), len(y)):
                rows += [(len(rows), x), (len(rows) + 1, y)]
                groups += 1
    got = line_dedup.dedup_lines(documents(spark, rows)).agg(F.sum("n_removed")).first()[0]
    assert groups > 100 and 0.97 * groups <= got <= 1.03 * groups


def test_line_dedup_whatever_the_size_of_buckets(spark, monkeypatch):
    r, rows = random.Random(4), []
    for k in range(150):  # pairs that share about half of their features
        a = prose(f"size {k}", 5)
        rows += [(2 * k, a), (2 * k + 1, "".join(r.choice("qxz") if i in (5, len(a) - 4) else c for i, c in enumerate(a)))]
    gone = lambda: {x.doc_id for x in line_dedup.dedup_lines(documents(spark, rows)).filter("n_removed > 0").collect()}
    want = gone()
    monkeypatch.setattr(line_dedup, "CHUNK", 1)  # every bucket is over-full
    assert len(want) > 50 and gone() == want


def test_every_pair_of_a_bucket_meets_once():
    import pyarrow as pa

    n, k = 50, 4
    chunk = np.arange(n) % k
    rows = [(min(j, c), max(j, c), i, int(j < c)) for i, c in enumerate(chunk.tolist()) for j in range(k)]
    rows = sorted(rows)
    table = pa.table({"bucket": pa.array([7] * len(rows)), "slot": pa.array([a * line_dedup.CHUNKS + b for a, b, _, _ in rows]), "part": pa.array([p for *_, p in rows], pa.int8())})
    keys = np.array([i for _, _, i, _ in rows])
    prints = np.zeros(len(rows), np.uint64)
    prints[keys % 2 == 1] = np.uint64(0b111)
    met = Counter()
    for low, high in ((-1, 2), (2, 20)):
        for a, b in line_dedup.near_pairs(line_dedup.group_numbers(table), prints, line_dedup.parts_of(table), low, high):
            met.update(map(frozenset, zip(keys[a].tolist(), keys[b].tolist(), strict=True)))
    assert len(met) == n * (n - 1) // 2 and set(met.values()) == {1}


def test_line_dedup_edges(spark, edge, nothing):
    got = line_dedup.dedup_lines(edge.withColumn("n_lines", F.lit("x"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) and by[1].text is None and by[1].n_lines == 0 and by[2].n_lines == 1
    assert by[6].text == "" and by[6].n_removed == 1 and by[3].n_removed == 0
    assert all(r.text == prose(5, 80) for r in got if r.doc_id == 5)
    assert by[None].n_removed == 0 and by[10].n_removed == 1
    assert line_dedup.dedup_lines(nothing).count() == 0


# 3


def test_base_statistics(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60).unionByName(edge.select("doc_id", "text", "lang"))
    want = sorted((str(r.doc_id), *brute_base(r.text)) for r in docs.collect())
    out = quality_rules.quality_rules(docs)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert got == want
    assert all(not r.kept for r in out.collect() if r.base_failed)


def brute_base(text):
    w = words(text)
    c, covered, seen, dup = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def brute_kneser_ney(texts, n):
    """Probability of a byte after n - 1 others, by the textbook recursion."""
    c = {n: Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))}
    for k in range(n - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d = {}
    for k in c:
        t = [sum(v == i for v in c[k].values()) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        raw = [i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0.5 * i for i in (1, 2, 3)]
        d[k] = [0] + [max(0.1 * i, min(float(i), x)) for i, x in zip((1, 2, 3), raw, strict=True)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        follow = {x: v for x, v in c[k].items() if x[:-1] == g[:-1]}
        if not follow:
            return p(g[1:])
        total, less = sum(follow.values()), lambda v: min(d[k][min(v, 3)], v)
        return (follow.get(g, 0) - (less(follow[g]) if g in follow else 0)) / total + sum(map(less, follow.values())) / total * p(g[1:])

    return p


def test_kneser_ney_brute_force(spark):
    texts = [prose(i, 40) for i in range(3)]
    model = quality_rules.fit_kneser_ney(documents(spark, list(enumerate(texts))))
    p = brute_kneser_ney([t.encode() for t in texts], quality_rules.ORDER)
    for text in (texts[0][:80], "unseen zebra the words!", prose(77, 6)):
        data = np.frombuffer(text.encode(), np.uint8)
        got = np.exp(model.log_probs(data, model.keys["en"]))
        want = [p(bytes(data[i : i + quality_rules.ORDER])) for i in range(len(data) - quality_rules.ORDER + 1)]
        assert np.allclose(got, want, rtol=2e-3)
    assert abs(sum(p(b"the " + bytes([x])) for x in range(256)) - 1) < 1e-9


def test_kneser_ney_keeps_every_gram(spark):
    r = random.Random(8)
    chars = [chr(c) for c in range(33, 127)]
    texts = ["".join(r.choice(chars) for _ in range(6000)) for _ in range(6)]
    model = quality_rules.fit_kneser_ney(documents(spark, list(enumerate(texts))))
    for k in range(1, quality_rules.ORDER + 1):
        seen = {t[i : i + quality_rules.ORDER][-k:] for t in texts for i in range(len(t) - quality_rules.ORDER + 1)}
        assert len(model.p[k - 1][0]) >= len(seen)


def test_quality_rules_edges(spark):
    rows = [(i, prose(i, 70), None if i % 3 else "en") for i in range(12)] + [(5, prose(5, 70), None), (5, prose(5, 70), None), (None, None, None), (50, "", "xx"), (51, "tail " * 60_000, "xx")]
    docs = documents(spark, rows).withColumns({"kept": F.lit("clash"), "base_failed": F.lit(1), "n_words": F.lit("clash"), "of": F.lit(0)})
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows) and all(r.kept in (True, False) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].n_words == by[50].n_words == 0 and by[51].n_words == 60_000 and by[51].base_failed
    names = quality_rules.lang_keys([f"l{i}" for i in range(5000)])
    assert len(set(names.values())) == 5001 and names[""] == 0


def test_quality_rules_keep_clean_and_reject_junk(spark):
    rows = [(i, prose(i, 150)) for i in range(150)] + [(1000, " ".join(w + "%%%" for w in prose(5, 150).split())), (1001, prose(3, 40).upper() + " !! " * 30), (1002, None), (1003, "x")]
    by = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert sum(by[i].kept for i in range(150)) == 150
    assert not by[1000].kept and not by[1000].base_failed
    assert not by[1002].kept and by[1003].base_failed
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0


# 4


def brute_contamination(docs, items, least=0.8):
    norm = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    sh = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    found = set()
    for d, text in docs:
        w = norm(text)
        for i, item in items:
            b = norm(item)
            k = min(5, len(b))
            if not b:
                continue
            y = sh(b, k)
            for s in range(max(1, len(w) - len(b) + 1)):
                x = sh(w[s : s + len(b)], k)
                if x and sum((x & y).values()) >= least * sum((x | y).values()):
                    found.add((d, i))
    return found


def test_contamination_brute_force(spark):
    r = random.Random(2)
    items = [(i, prose(500 + i, r.choice((2, 4, 8, 30, 60)))) for i in range(25)] + [(90, None), (91, "  "), (92, items_text := prose(900, 70))]
    docs = []
    for d in range(60):
        w = prose(2000 + d, 120).split()
        if d % 3:
            part = (r.choice(items)[1] or "").upper().split()
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                if part:
                    part[r.randrange(len(part))] = "changed"
            w[40:40] = part
        docs.append((d, " ".join(x + r.choice(("", ".", "&&&")) for x in w)))
    docs += [(100, None), (101, ""), (102, items_text.replace(" ", "\n")), (103, prose(1, 3000) + " " + items_text + " " + prose(2, 30_000))]
    want = brute_contamination(docs, items)
    frame = spark.createDataFrame(items, "item_id long, text string")
    for size in (8_000_000, 300):  # in one block, and in many
        got = decontaminate.find_contamination(documents(spark, docs), frame, block_bytes=size)
        assert {(x.doc_id, x.item_id) for x in got.collect()} == want
        clean = decontaminate.decontaminate(documents(spark, docs), frame, block_bytes=size)
        assert {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert len(want) > 20
    assert decontaminate.find_contamination(documents(spark, []), frame).count() == 0
    assert decontaminate.find_contamination(documents(spark, docs), frame.limit(0)).count() == 0
    rows = documents(spark, [(None, items_text), (7, items_text), (7, items_text), (8, None)]).withColumn("item_id", F.lit("clash")).withColumn("similarity", F.lit("clash"))
    assert sorted((x.doc_id or 0, x.item_id) for x in decontaminate.find_contamination(rows, frame).collect()) == [(0, 92), (7, 92), (7, 92)]
    assert [x.doc_id for x in decontaminate.decontaminate(rows, frame).collect()] == [8]


def test_contamination_recall_over_all_windows(spark):
    """Items with edits, against the best similarity of all windows, whatever their fingerprints."""
    r = random.Random(41)
    items = [(i, prose(f"item {i}", r.randint(12, 70))) for i in range(150)]
    docs = []
    for i, text in items:
        part = text.split()
        for _ in range(r.choice((0, 1, 1, 2))):
            at = r.choice((0, 1, 2, r.randrange(len(part)), len(part) - 1))
            part[at : at + 1] = r.choice(([], ["new"], ["new", part[at]]))
        docs.append((i, " ".join([prose(f"before {i}", 30), *part, prose(f"after {i}", 30)])))
    want = brute_contamination(docs, items)
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 80 and got <= want and len(got) >= 0.97 * len(want)


def test_hamming_blocks_find_all_within_radius():
    b = decontaminate.Benchmark(list(range(40)), [prose(i, 30) for i in range(40)])
    r = random.Random(8)
    for _ in range(60):
        i = r.randrange(40)
        p = int(b.prints[i])
        for bit in r.sample(range(64), r.randint(0, decontaminate.RADIUS)):
            p ^= 1 << bit
        w, found = b.within_radius(np.array([p], np.uint64))
        want = [j for j in range(40) if bin(p ^ int(b.prints[j])).count("1") <= decontaminate.RADIUS]
        assert list(found) == want and i in want and set(w) == {0}


# 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=30) | st.sampled_from(["<|turn|>", "</s>[INST] ok [/INST]", "<|end|>\n", "\\N\\", "<<SYS>>", "<|"])), max_size=6))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert text.count(chat.TURN) == text.count("<|end|>") == len(turns)
    assert "[INST]" not in text and "</s>" not in text
    assert [chat.unescape(text[a : a + n]) for a, n in spans] == [t for _, t in turns]


def test_chat_windows(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("assistant", "user")[t % 2], prose(t, 60)) for t in range(1, 40)]
    rows += [(2, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, 0, "user", "hi"), (3, 0, "system", "alone"), (4, 0, "user", prose(1, 5000)), (4, 1, "assistant", "short")]
    talks = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, window int")
    w = chat.format_conversations(talks, TOKENIZER, budget=600, history=200)
    mine = sorted((x for x in w.collect() if x.conv_id == 1), key=lambda x: x.window)
    assert len(mine) > 3 and all(x.n_tokens <= 600 for x in mine)
    assert all(chat.parse(x.text)[0] == ("system", "be kind") for x in mine)
    assert all(x.n_repeated > 1 for x in mine[1:]) and mine[0].n_repeated == 0
    by = {x.conv_id: x for x in chat.read_back(w).collect()}
    for conv in (1, 2, None, 3, 4):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert by[conv].n_turns == len(turns)
        assert by[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (by[conv].loss_chars, by[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(talks.limit(0), TOKENIZER).count() == 0


# 6


def test_mixing(spark, edge, nothing):
    got = mixing.mix_sources(edge.withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))).collect()
    assert len(got) == len(EDGE) and all(r.size == len(words(r.text)) for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in per.values()) - total) < 1e-6
    for rows in per.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in rows) and rows[0].target <= 3 * rows[0].source_size + 1e-9
    assert mixing.mix_sources(nothing).count() == 0
    assert all(r.taken == 0 for r in mixing.mix_sources(documents(spark, [(1, None), (2, "")])).collect())


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000, 1], [5, 0, 1000], [3, 3, 3, 900]])
def test_water_filling_by_rounds(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.water_levels(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    w = {f"s{i}": 1 + i % 3 for i in range(len(sizes))}
    free, left, want = dict(rows), float(sum(sizes)), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * free[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * free.pop(s)
            left -= want[s]
    assert got == pytest.approx(want)


def test_mixing_is_the_same_again(spark, sf):
    key = lambda d: sorted((r.doc_id, r.taken) for r in d.collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert key(mixing.mix_sources(docs)) == key(mixing.mix_sources(docs.repartition(7)))


# 7


def test_quality_classifier_held_out(spark, sf):
    got = queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 80 and sum(r.predicted == r.quality for r in got) / len(got) > 0.96
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_attention_gradients():
    r = np.random.default_rng(0)
    m = mil.GatedAttention(width=6, encoded=4, gate=3)
    m.mean, m.scale = np.zeros(6), np.ones(6)
    m.w["w"] = r.normal(size=4)
    x, first, y, weight = r.normal(size=(9, 6)), np.array([0, 2, 5, 9]), np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])

    def loss():
        p = m.forward(x, first)[-1]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grads = m.gradients(x, first, y, weight)
    for k, w in m.w.items():
        for at in [tuple(r.integers(0, n) for n in w.shape) for _ in range(4)]:
            old = w[at]
            w[at] = old + 1e-6
            up = loss()
            w[at] = old - 1e-6
            down = loss()
            w[at] = old
            assert grads[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_quality_edges(spark, edge, nothing):
    model = mil.fit_quality(edge, spark.createDataFrame([(5, 1), (9, 0), (9, 0), (1, None), (2, 7)], "doc_id long, label int"))
    got = mil.score_documents(edge, model).collect()
    assert len(got) == len(EDGE) and len({round(r.score, 12) for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert mil.score_documents(nothing, model).count() == 0
    assert {r.score for r in mil.score_documents(edge, mil.GatedAttention()).collect()} == {0.5}


def test_quality_scores_against_the_definition(spark):
    """Every passage is encoded by itself; the gates and the weighted sum are worked out in plain Python."""
    import math

    text, r = prose("mil", 64 * 300 + 7), np.random.default_rng(1)  # more passages than a document once had
    model = mil.GatedAttention()
    model.w = {k: r.normal(0, 0.5, v.shape) for k, v in model.w.items()}
    model.mean, model.scale = r.normal(size=mil.WIDTH), r.uniform(0.5, 2, mil.WIDTH)
    got = {x.doc_id: x.score for x in mil.score_documents(documents(spark, [(1, text), (2, "x " + text), (3, None)]).withColumn("score", F.lit("clash")), model).collect()}
    data = np.frombuffer(text.encode(), np.uint8)
    x, first = mil.Encoder()(data, np.array([0, len(data)]))
    assert list(first) == [0, 301]
    sigmoid, w = lambda v: 1 / (1 + math.exp(-v)), model.w
    encoded = [[math.tanh(sum(((row[i] - model.mean[i]) / model.scale[i]) * w["W"][i, j] for i in range(len(row))) + w["c"][j]) for j in range(w["W"].shape[1])] for row in x.astype(float)]
    gates = [sum(math.tanh(sum(a * b for a, b in zip(e, w["V"][:, j], strict=True))) * sigmoid(sum(a * b for a, b in zip(e, w["G"][:, j], strict=True))) * w["u"][j] for j in range(len(w["u"]))) for e in encoded]
    top = [math.exp(g) for g in gates]
    pooled = [sum(t * e[j] for t, e in zip(top, encoded, strict=True)) / sum(top) for j in range(len(encoded[0]))]
    assert got[1] == pytest.approx(sigmoid(sum(a * b for a, b in zip(pooled, w["w"], strict=True)) + w["b"][0]), rel=1e-6)
    assert got[2] != got[1]


def test_quality_learns_from_all_passages(spark):
    docs = documents(spark, [(i, " ".join([prose(i, 64 * 400), ("### " if i % 2 else "fine ") * 64, prose(i + 500, 64 * 400)])) for i in range(4)])
    seen = []
    fit = mil.GatedAttention.fit
    mil.GatedAttention.fit = lambda self, bags, y: seen.extend(len(b) for b in bags)
    try:
        mil.fit_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, label int"))
    finally:
        mil.GatedAttention.fit = fit
    assert seen == [801] * 4


# 8


def brute_simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    prints = {}
    for d, t in rows:
        prints.setdefault(brute_simhash(t), []).append(d)
    u = Union(prints)
    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                u.join(a, b)
    least = {}
    for p, ds in prints.items():
        least[u.find(p)] = min([x for x in ds if x is not None] + [least.get(u.find(p), 1 << 60)])
    return {d: (f"{p:016x}", least[u.find(p)]) for p, ds in prints.items() for d in ds}


def test_simhash_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    base = prose(1, 400).split()
    for i in range(60):  # near copies, each some words off the last, so that groups are chains
        base[i * 5] = f"w{i}"
        docs.append((10_000 + i, " ".join(base)))
    docs += [(20_000, None), (20_001, ""), (20_002, "One two"), (20_003, "one  TWO")]
    want = brute_groups(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_groups(documents(spark, docs).withColumn("fp", F.lit("clash"))).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 10


def test_simhash_edges(spark, edge, nothing):
    got = simhash_dedup.simhash_groups(edge).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) and {by[i].fingerprint for i in (1, 2, 3)} == {"0" * 16} and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[6].component_id == 5 and simhash_dedup.simhash_groups(nothing).count() == 0
    with pytest.raises(ValueError):
        simhash_dedup.fingerprint_links(edge.select(F.col("doc_id").alias("fp")), radius=3)


def brute_near_copies(rows, least=0.8):
    """The least id of each row's group, by comparing all pairs; and the pairs of different words."""
    norm = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    sets = {}
    for d, t in rows:
        w = norm(t)
        sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    u, pairs = Union(sets), []
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or sum((sets[a] & sets[b]).values()) >= least * sum((sets[a] | sets[b]).values()) > 0):
                u.join(a, b)
                pairs += [(a, b)] * (sets[a] != sets[b])
    return {d: u.find(d) for d in sets}, pairs


def test_near_copies_brute_force(spark, sf):
    r, docs = random.Random(12), [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    for i in range(150):  # one copy each, with up to a tenth of the shingles changed
        w = prose(f"near {i}", r.choice((20, 60, 200, 600))).split()
        docs.append((10_000 + 2 * i, " ".join(w)))
        for at in r.sample(range(len(w)), max(1, int(len(w) * r.choice((0.005, 0.01, 0.02))))):
            w[at] = f"w{at}"
        docs.append((10_001 + 2 * i, " ".join(w)))
    docs += [(20_000, None), (20_001, ""), (20_002, "One two"), (20_003, "one  TWO!")]
    want, pairs = brute_near_copies(docs)
    kept = {x.doc_id for x in simhash_dedup.drop_near_copies(documents(spark, docs).withColumn("root", F.lit("clash"))).collect()}
    assert set(want.values()) <= kept and len(pairs) > 80
    assert len(kept - set(want.values())) <= 0.03 * len(pairs)


def test_near_copies_in_a_large_group(spark):
    r, base = random.Random(5), prose("base", 300).split()
    rows = []
    for i in range(400):
        w = list(base)
        w[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert [x.doc_id for x in simhash_dedup.drop_near_copies(documents(spark, rows)).collect()] == [0]


def test_near_copies_without_ids(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (None, b.upper()), (None, c), (None, None), (None, None)]
    got = simhash_dedup.drop_near_copies(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text.lower() if r.text else "") for r in got) == sorted([(1, a), (1, a), (0, b), (0, c), (0, "")])


# 9


def test_extraction_of_the_tables_pages(spark, sf):
    import html

    rows = queries.op9_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div)\b[^>]*>", " ", body)))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)


def test_extraction_of_generated_pages():
    model, v, wrong, total = html_extract.fit_labeller(), html_extract.Vectors(), 0, 0
    for i in range(60):
        blocks, y = html_extract.labelled_blocks(html_extract.PageWriter(77_000_000 + i).page())
        if blocks:
            wrong += int((model.label([v.page(blocks)])[0] != (y > 0.5)).sum())
            total += len(blocks)
    assert wrong / total < 0.02


def test_lstm_gradients():
    r = np.random.default_rng(0)
    m = html_extract.Lstm(5, 3, r)
    x, mask, dout = r.normal(size=(4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float), r.normal(size=(4, 2, 3))
    grads = m.backward(x, mask, m.forward(x, mask, True)[1], dout)
    for k, w in m.w.items():
        at = tuple(r.integers(0, n) for n in w.shape)
        old = w[at]
        w[at] = old + 1e-6
        up = (m.forward(x, mask)[0] * dout).sum()
        w[at] = old - 1e-6
        down = (m.forward(x, mask)[0] * dout).sum()
        w[at] = old
        assert grads[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_block_reader():
    page = "<body><nav><a href=x>Menu</a></nav><article><p>One&amp;<b>two</b>\n three<p>Next<br>line<script>var p='<p>no</p>'</script></article><!-- no --><form><button>no</button><label>Name</label></form><p title='a>b'>End"
    got = [(b.path[-1][0], t) for b, t in html_extract.pages_blocks(page)]
    assert got == [("a", "Menu"), ("p", "One&two three"), ("p", "Next line"), ("label", "Name"), ("p", "End")]
    assert html_extract.pages_blocks("") == [] and html_extract.pages_blocks("<p><b></p>  ") == []


def test_references_end_where_markup_begins():
    page = "<p>a&am<b>p;</b> &lt<i>;x</i> &eacute;&#x41;&#66; R&D &amp;lt; &nbsp;</p><p>&nbsp; &#32;</p>"
    assert [t for _, t in html_extract.pages_blocks(page)] == ["a&amp; <;x éAB R&D &lt;"]


def test_block_reader_long_values_and_whole_blocks():
    for n in (10, 5000, 100_000):
        value = "<p>a</p> > " * (n // 10)
        page = f"""<div data-x="{value}" class='c'>One</div><p title="5" tall">two</p><p id="open>three</p>"""
        assert [t for _, t in html_extract.pages_blocks(page)] == ["One", "two", "three"]
    names = " ".join(f"n{chr(97 + i)}" for i in range(20))
    assert len(html_extract.names_of(f' class="{names}"')) == 20
    words = "word " * 300
    one, other = (html_extract.Vectors().page([(html_extract.Block(()), words + tail)])[0] for tail in ("tail 2024.", "else words."))
    assert (one != other).any()


def test_extraction_edges(spark):
    model = html_extract.fit_labeller(60)
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<html>"), (3, "u", "<html>"), (4, "u", "<p>" + "word " * 200_000), (5, "u", "<" * 5000), (None, "u", "<p x=\"unclosed>text")]
    got = html_extract.extract_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"), model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 3)} == {""}


# 10


def test_repeated_passages_brute_force(spark):
    r, rows = random.Random(4), []
    shared = [prose(700 + i, 90) for i in range(6)]
    flagged = set()
    for d in range(60):
        w = prose(3000 + d, r.choice((20, 150, 400))).split()
        if d % 2:
            part = r.choice(shared).split()
            for _ in range(r.choice((0, 1, 2))):
                part[r.randrange(20, 70)] = "changed"
            at = r.randrange(len(w))
            w[at:at] = part
            flagged.add(d)
        rows.append((d, " ".join(w)))
    rows += [(200, "Same! " * 80), (201, "same " * 75), (202, prose(9, 60)), (203, prose(9, 60).upper()), (204, prose(12, 45)), (205, prose(12, 45)), (300, None), (301, ""), (None, prose(13, 90))]
    got = {x.doc_id: x for x in chaining.repeated_passages(documents(spark, rows).withColumn("passages", F.lit(0))).collect()}
    assert set(got) == flagged | {200, 201, 202, 203}
    norm = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())
    grams = Counter(g for d, t in rows for g in {tuple(norm(t or "")[i : i + 50]) for i in range(len(norm(t or "")) - 49)})
    for d, t in rows:  # every word of an exactly shared run of 50 lies in a passage
        w = norm(t or "")
        inside = {i + j for i in range(len(w) - 49) if grams[tuple(w[i : i + 50])] > 1 for j in range(50)}
        if d == 200:  # one word again and again: each run of 50 stands in the shorter text too
            assert [tuple(p) for p in got[d].passages] == [(0, 80)]
        elif inside:
            covered = {i for p in got[d].passages for i in range(p.start_word, p.start_word + p.n_words)}
            assert inside <= covered
    assert got[203].class_id == 202 and got[203].component_id == 202 and got[201].component_id == 200
    assert all(sum(p.n_words for p in x.passages) == x.n_repeated_words and len(x.passages) == x.n_passages for x in got.values())


def test_repeated_passages_recall_of_edits(spark):
    r, rows = random.Random(31), []
    for n, every in ((50, 20), (60, 10), (80, 8), (60, 6), (50, 5)):
        for k in range(6):
            part = prose(f"{n} {every} {k}", n).split()
            other = [f"x{r.randrange(10**9)}" if i % every == every // 2 else w for i, w in enumerate(part)]
            for p in (part, other):
                rows.append((len(rows), " ".join([prose(r.random(), 60), *p, prose(r.random(), 60)])))
    got = {x.doc_id for x in chaining.repeated_passages(documents(spark, rows)).collect()}
    assert len(got) >= 0.97 * len(rows)


def test_repeated_passages_with_common_phrases_and_repeats(spark):
    rows, pairs = [], []
    for k in range(12):  # pairs of 50 words that hold a phrase which many other texts hold
        phrase, part = prose(f"phrase {k}", 26), prose(f"part {k}", 24)
        pairs += [len(rows), len(rows) + 1]
        rows += [(len(rows) + i, f"{prose(f'a {k} {i}', 40)} {phrase} {part} {prose(f'b {k} {i}', 40)}") for i in range(2)]
        rows += [(len(rows) + i, f"{prose(f'c {k} {i}', 40)} {phrase} {prose(f'd {k} {i}', 40)}") for i in range(6)]
    twice = []
    for k in range(6):  # one says twice what the other says once
        part = prose(f"twice {k}", 60)
        twice.append(len(rows))
        rows += [(len(rows), f"{part} {prose(f'e {k}', 50)} {part}"), (len(rows) + 1, f"{prose(f'f {k}', 30)} {part}")]
    got = {x.doc_id: x for x in chaining.repeated_passages(documents(spark, rows)).collect()}
    assert set(pairs) <= set(got) and all(got[d].n_repeated_words >= 120 for d in twice)


def test_repeated_passages_among_rivals(spark):
    r, rows, edited = random.Random(77), [], {}
    for share in (0, 0.05, 0.1, 0.15, 0.18):
        for k in range(20):
            part = prose(f"rival {share} {k}", 60).split()
            other = [f"x{r.randrange(10**9)}" if r.random() < share else w for w in part]
            edited.setdefault(share, []).append(len(rows))
            rows += [(len(rows) + i, " ".join([prose(r.random(), 50), *p, prose(r.random(), 50)])) for i, p in enumerate((part, other))]
            if not share:  # pieces of 9 to 12 words stand in other texts
                at = 0
                while at < 60:
                    n = r.randint(9, 12)
                    rows.append((len(rows), " ".join([prose(r.random(), 30), *part[at : at + n], prose(r.random(), 30)])))
                    at += n
    got = {x.doc_id for x in chaining.repeated_passages(documents(spark, rows)).collect()}
    recall = {share: sum(d in got and d + 1 in got for d in ds) / len(ds) for share, ds in edited.items()}
    assert recall[0] == recall[0.05] == 1 and recall[0.1] >= 0.95 and recall[0.15] >= 0.9 and recall[0.18] >= 0.8
    assert got <= {d + i for ds in edited.values() for d in ds for i in (0, 1)}  # pieces of other texts don't add up


def test_repeated_passages_edges(spark, edge, nothing):
    got = chaining.repeated_passages(edge).collect()
    assert sorted(r.doc_id for r in got) == [5, 5, 6] and {r.n_repeated_words for r in got} == {80}
    assert chaining.repeated_passages(nothing).count() == 0


def test_op10_aligns_a_group_of_near_copies_once_a_member(spark, monkeypatch):
    """Each copy with edits of its own, and texts that say a line again and again: alignments that tell nothing new aren't made, and every copy is still one passage."""
    r = random.Random(5)
    words = [f"w{r.randint(0, 10**9)}" for _ in range(200)]
    texts = []
    for i in range(40):
        own = list(words)
        for at in r.sample(range(20, 180), 12):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
    texts += [" ".join(["one line says it all over"] * n) for n in (30, 40, 50)]
    made, plain = [], chaining.aligned

    def counted(*args):
        out = plain(*args).localCheckpoint()
        made.append(out.count())
        return out

    monkeypatch.setattr(chaining, "aligned", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in chaining.repeated_passages(docs).collect()}
    assert sum(made) <= 2 * len(texts)
    assert all(got[i].component_id == 0 and [tuple(p) for p in got[i].passages] == [(0, 200)] for i in range(40))
    assert all(got[i].component_id == 40 and got[i].n_repeated_words == len(texts[i].split()) for i in (40, 41, 42))


def test_op10_aligns_pairs_between_a_seeds_ends(spark):
    """Two texts share a passage with edits, each piece of which stands in texts of lesser and of greater hash: the stars' ends aren't among the two."""
    hasher, table = Hasher(), byte_table(True)

    def mark(text):
        return next(int(chaining.row_hashes(h, w.first)[0].view(np.int64)) for _, w, h in word_hashes(pa.array([text]), hasher, table))

    rows, pairs = [], []
    for k in range(8):
        part = prose(f"between {k}", 66).split()
        other = [f"x{k}y{i}" if i % 11 == 10 else w for i, w in enumerate(part)]
        made = lambda p, t: " ".join([prose(f"bq {k} {t} {p[10]}", 40), *p, prose(f"br {k} {t} {p[10]}", 40)])  # noqa: E731, B023
        texts = [next(x for t in range(99) if abs(mark(x := made(p, t))) < 1 << 62) for p in (part, other)]  # neither is an end
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + i, t) for i, t in enumerate(texts)]
        for n, at in enumerate(range(0, 66, 11)):
            for low in (True, False):
                piece = (" ".join([prose(f"bs {k} {n} {low} {t}", 30), *part[at : at + 10], prose(f"bt {k} {n} {low} {t}", 30)]) for t in range(99))
                rows.append((len(rows), next(x for x in piece if (mark(x) < -(1 << 62) if low else mark(x) > 1 << 62))))
    got = {x.doc_id: x for x in chaining.repeated_passages(documents(spark, rows)).collect()}
    assert set(got) == {d for p in pairs for d in p}
    assert all(got[a].component_id == got[b].component_id == a and got[a].n_repeated_words >= 55 for a, b in pairs)


def test_open_pairs_are_all_but_the_settled(monkeypatch):
    r = np.random.default_rng(3)
    for n, most in ((1, 9), (2, 9), (7, 3), (60, 9), (60, 1000)):
        monkeypatch.setattr(chaining, "PAIRS", most)
        key, label, covered = r.integers(0, 3, n), r.integers(0, 4, n), r.random(n) < 0.6
        order = np.lexsort((covered, label, key))
        key, label, covered = key[order], label[order], covered[order]
        got = [x for a, b in chaining.open_pairs(key, label, covered) for x in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and (label[i] != label[j] or not (covered[i] and covered[j]))}
