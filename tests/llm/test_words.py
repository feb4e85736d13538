"""Shared text handling, quality rules, language identification, substring dedup."""

import hashlib
import re
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pytest

from kinespark.llm import arrowtext as at
from kinespark.llm import language_id, quality_crf, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n", "a", "a b\x0bc\x0cd\re", "é ü x 日本 🙂", "x" * 5000, "one two " * 400, "\n\n a\n a\n", "|||| $$ ##"]


def buffers(texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def table(spark, texts, first=0, extra=""):
    rows = [(first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS text_b", "1 AS k1", "2 AS row", "'l' AS lang", "'s' AS source" + extra)


def test_words_and_hashes():
    raw, offsets = buffers(ODD)
    w = at.split(raw, offsets)
    got = [[bytes(raw[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.rows[:-1], w.rows[1:])]
    assert got == [WORD.findall(t or "") for t in ODD]
    h = w.hashes()
    by = {}
    for x, word in zip(h.tolist(), sum(got, [])):
        assert by.setdefault(word, x) == x
    assert len(set(by.values())) == len(by)
    inside = at.inside(w.rows, 3)
    n = 0
    for i, j in zip(w.rows[:-1], w.rows[1:]):
        n += max(0, j - i - 2)
    assert inside.sum() == n
    both = at.window_hashes(h, 3)
    assert both[np.flatnonzero(inside)[0]] == at.window_hashes(h[w.rows[4] : w.rows[5]], 3)[0]


def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit)


def labelled(spark):
    good = ["The quick brown fox jumps over the lazy dog again and again, " + f"said number {i} of many.\nThen it went home to sleep, as {i} others did." for i in range(20)]
    bad = [f"Home{i} | About{i} | Contact{i} | News{i} | Jobs{i}\n$$$ buy{i} ### now{i} $$$ %% &&& cheap{i} ### pills{i} *** | | |" for i in range(20)]
    docs = table(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, good + bad + ODD


def test_quality_base_counts_and_verdicts(spark):
    docs, labels, texts = labelled(spark)
    rows = {r.doc_id: r for r in quality_crf.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert all(rows[i].kept for i in range(20)) and not any(rows[i].kept for i in range(20, 40))
    kept = quality_crf.passing(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert quality_crf.judge(docs.limit(0), labels.limit(0)).count() == 0
    assert np.array_equal(quality_crf.train(docs, labels.limit(0)), quality_crf.PRIOR)
    with pytest.raises(ValueError, match="text"):
        quality_crf.judge(docs.drop("text"), labels)


def test_viterbi_is_the_best_labelling_and_training_raises_likelihood():
    rng = np.random.default_rng(0)
    size = [3, 0, 1, 6, 4]
    rows = np.r_[0, np.cumsum(size)]
    e, pairs = rng.normal(size=rows[-1]), rng.normal(size=(2, 2))
    got = quality_crf.viterbi(e, rows, pairs)
    score = lambda y, x: sum(v for v, k in zip(x, y) if k) + sum(pairs[a, b] for a, b in zip(y, y[1:]))
    for i, j in zip(rows[:-1], rows[1:]):
        if j > i:
            best = max(product((0, 1), repeat=j - i), key=lambda y: score(y, e[i:j]))
            assert score(got[i:j].astype(int).tolist(), e[i:j]) == pytest.approx(score(best, e[i:j]))

    def loglike(theta, x, y):
        em, pr = x @ theta[: quality_crf._N], theta[quality_crf._N :].reshape(2, 2)
        f = lambda lab, v: sum(q for q, k in zip(v, lab) if k) + sum(pr[a, b] for a, b in zip(lab, lab[1:]))
        total = 0
        for i, j in zip(rows[:-1], rows[1:]):
            if j > i:
                total += f(y[i:j].astype(int).tolist(), em[i:j]) - np.logaddexp.reduce([f(lab, em[i:j]) for lab in product((0, 1), repeat=j - i)])
        return total

    x, y = rng.normal(size=(rows[-1], quality_crf._N)), rng.integers(0, 2, rows[-1]).astype(float)
    theta = rng.normal(size=quality_crf._N + 4) * 0.3
    g = quality_crf._gradient(theta, x, y, rows)
    for k in (0, 5, quality_crf._N, quality_crf._N + 3):
        d = np.zeros_like(theta)
        d[k] = 1e-5
        assert g[k] == pytest.approx((loglike(theta + d, x, y) - loglike(theta - d, x, y)) / 2e-5, abs=1e-4)


def brute_kept(t, theta):
    """The verdict by trying every labelling of the lines (few), from the features of the module."""
    raw, offsets = buffers([t])
    got = quality_crf.lines_of(raw, offsets)
    if not len(got.features):
        return 0.0
    e, pairs = got.features @ theta[: quality_crf._N], theta[quality_crf._N :].reshape(2, 2)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    assert [sum(map(len, WORD.findall(x))) for x in lines] == got.chars.tolist()
    best = max(product((0, 1), repeat=len(lines)), key=lambda y: sum(v for v, k in zip(e, y) if k) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
    return sum(c for c, k in zip(got.chars.tolist(), best) if k) / sum(got.chars.tolist())


SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_kept_is_the_brute_force_verdict_and_mixed_documents_are_split(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    theta = quality_crf.train(docs, labels)
    rows = {r.doc_id: r for r in quality_crf.judge(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    few = [i for i, r in rows.items() if 0 < r.n_lines <= 9]
    assert len(few) > 200
    for i in few:
        share = brute_kept(texts[i], theta)
        assert rows[i].content_share == pytest.approx(share, abs=1e-6) and rows[i].kept == (not rows[i].base_failed and share >= quality_crf.CONTENT_SHARE)
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    told = [i for i in quality if i in rows]
    assert sum(rows[i].kept for i in told if quality[i]) >= 0.97 * sum(quality[i] > 0 for i in told)
    assert not any(rows[i].kept for i in told if not quality[i])
    good, bad = ([i for i in sorted(told) if quality[i] == y and rows[i].n_words >= 30] for y in (1, 0))
    mixed = [(k, texts[g] + "\n" + texts[b], rows[g].word_chars / (rows[g].word_chars + rows[b].word_chars)) for k, (g, b) in enumerate(zip(good[:40], bad[:40]))]
    table_ = spark.createDataFrame([x[:2] for x in mixed], "doc_id long, text string")
    got = {r.doc_id: r.content_share for r in quality_crf.judge(table_, labels, theta=theta).collect()}
    off = np.array([abs(got[k] - want) for k, _, want in mixed])
    assert (off <= 0.05).mean() >= 0.9 and np.mean(off) < 0.05, off.round(3).tolist()


LANGS = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "qwxz kzzq wqkx xxqz zkwq qqzx", "cc": "ñandú árbol écho öffnung über straße"}


def speak(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split(), n))


def test_language_held_out_accuracy_mixtures_and_edge_cases(spark):
    import zlib

    rng = np.random.default_rng(1)
    rows = [(i, speak(rng, lang, 30), lang, "s") for i, lang in enumerate(rng.choice(list(LANGS), 90))]
    mixed = speak(rng, "aa", 70) + " " + speak(rng, "bb", 30)
    rows += [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "123 !!", "bb", "s"), (1003, mixed, None, None), (1003, mixed, None, None), (None, LANGS["cc"], "cc", "s"), (1004, "日本", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [r.asDict() for r in language_id.predict(docs).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    held = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i]["held_out"] == (i in held) for i in range(90))
    assert all(by[i]["lang_pred"] == rows[i][2] for i in held)
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0 and by[1004]["lang_pred"] in LANGS
    assert by[1003]["lang_pred"] == "aa" and by[1003]["n_langs"] == 2 and by[1003]["score"] == pytest.approx(0.7, abs=0.05)
    assert by[None]["lang_pred"] == "cc" and by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.predict(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs.selectExpr("doc_id", "text", "CAST(null AS string) AS lang")).collect()} == {"und"}


def test_language_ignores_labels_and_ids_when_predicting(spark):
    rng = np.random.default_rng(2)
    rows = [(i, speak(rng, lang, 20), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    lied = spark.createDataFrame([(i, t, ("bb" if lang == "aa" else "aa") if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    f = lambda d: sorted(map(tuple, language_id.predict(d).collect()))
    assert f(docs) == f(lied)


def test_em_finds_the_likeliest_proportions():
    rng = np.random.default_rng(3)
    like = np.log(rng.random((400, 2)))
    theta, fit = language_id.mixture(like, np.array([0, 400]), steps=300)
    grid = np.linspace(0.001, 0.999, 999)
    values = [np.log(np.exp(like) @ [p, 1 - p]).sum() for p in grid]
    assert theta[0, 0] == pytest.approx(grid[int(np.argmax(values))], abs=2e-3) and fit[0] == pytest.approx(max(values), abs=1e-3)


def test_language_set_is_the_best_found_by_brute_force():
    """Greedy growth against EM on every set of languages, for short documents."""
    rng = np.random.default_rng(8)
    size = rng.integers(5, 60, 60)
    rows = np.r_[0, np.cumsum(size)]
    like = rng.normal(-20, 2.5, (rows[-1], 4))
    for i, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
        half = a + (b - a) * (i % 3) // 4
        like[a:half, i % 4] += 9
        like[half:b, (i + 1) % 4] += 9
    best, share, kinds = language_id.identify(like, rows)
    same = 0
    for i, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
        cost = language_id.PENALTY + 0.5 * np.log(b - a)
        found = []
        for mask in product((0, 1), repeat=4):
            use = np.flatnonzero(mask)
            if len(use):
                theta, fit = language_id.mixture(np.ascontiguousarray(like[a:b][:, use]), np.array([0, b - a]), steps=200)
                found.append((fit[0] - cost * (len(use) - 1), use[theta[0].argmax()], theta[0].max(), len(use)))
        top = max(found)
        same += (top[1], top[3]) == (best[i], kinds[i]) and abs(top[2] - share[i]) < 0.02
    assert same >= 59


def brute_substring(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    c = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if c[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_covers_meet_every_shift():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substring_dedup.cover_for(35) == (21, (3, 6, 7, 12, 14), 15) and substring_dedup.cover_for(3)[2] >= 1


@pytest.mark.parametrize("window", [35, 12, 3])
def test_substring_dedup_against_brute_force(spark, window):
    rng = np.random.default_rng(window)
    passage = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((34, 35, 36, 60, 90, 12))]
    texts = list(ODD)
    for _ in range(60):
        w = [f"u{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(0, 80)))]
        for k in rng.choice(6, int(rng.integers(0, 3))):
            at_ = int(rng.integers(0, len(w) + 1))
            w[at_:at_] = passage[k]
        texts.append(str(rng.choice([" ", "\n", "  ", " \t"])).join(w))
    texts += [texts[-1], "same words here " * 30, "z " + " ".join(passage[4]) + " y", None]
    df = table(spark, texts)
    rows = {r.doc_id: r for r in substring_dedup.judge(df, window=window).collect()}
    want = brute_substring(texts, window)
    for i, (n, gone, digest, _) in enumerate(want):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (n, gone, digest), i
    left = substring_dedup.without_repeats(df, window=window)
    assert left.columns == df.columns
    for r in left.collect():
        t = texts[r.doc_id]
        if want[r.doc_id][1] == 0:
            assert r.text == t
        else:
            assert " ".join(WORD.findall(r.text)) == want[r.doc_id][3]


def test_substring_dedup_repeated_ids_null_ids_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, long), (1, long), (None, long + " tail"), (None, "short"), (2, None)], "doc_id long, text string")
    as_text = df.selectExpr("concat('id', doc_id) AS doc_id", "text", "1 AS `a.b`", "2 AS __k1", "3 AS __left", "4 AS row", "5 AS k2", "6 AS places")
    rows = sorted((str(r.doc_id).replace("id", ""), r.n_words, r.n_removed) for r in substring_dedup.judge(as_text).collect())
    assert rows == sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.judge(df).collect())
    left = substring_dedup.without_repeats(as_text)
    assert left.columns == as_text.columns and {(r["a.b"], r["__k1"], r["__left"], r["row"], r["k2"]) for r in left.collect()} == {(1, 2, 3, 4, 5)}
    assert rows == [("1", 40, 40), ("1", 40, 40), ("2", 0, 0), ("None", 1, 0), ("None", 41, 40)]
    assert sorted(str(r.text) for r in substring_dedup.without_repeats(df).collect()) == ["", "", "None", "short", "tail"]
    assert substring_dedup.judge(df.limit(0)).count() == 0 and substring_dedup.without_repeats(df.limit(0)).count() == 0
