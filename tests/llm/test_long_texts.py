"""Texts longer than a chunk of any operator's reading, beside short ones: read whole, with the same results as by themselves."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from kinespark.llm import arrowtext as at
from kinespark.llm import language_id, license_scan, mixing, order_minhash, quality_crf, sentencepiece_codec, sharding, substring_dedup
from kinespark.llm.queries import MODEL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(spark):
    """A text of 2.5 MB, a near copy of it, the same with a license at its end, and short texts; all its words are rare but a passage."""
    rng = np.random.default_rng(4)
    words = [f"w{x:x}" for x in rng.integers(0, 2**40, 220_000)]
    near = list(words)
    near[1000], near[150_000] = "changed", "here"
    passage = [f"p{i}" for i in range(60)]
    lines = lambda w: "\n".join(" ".join(w[i : i + 40]) for i in range(0, len(w), 40))
    texts = [lines(words), lines(near), lines([f"v{x:x}" for x in rng.integers(0, 2**40, 210_000)] + passage) + "\n" + license_scan.TEMPLATES["MIT"], " ".join(passage) + " short end", None, "", "one"]
    assert all(len(t) > 1.05 * at.CHUNK_BYTES for t in texts[:3])
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3).cache()
    return df, texts


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_words_lines_and_sizes(spark, table):
    df, texts = table
    labels = spark.createDataFrame([], "doc_id long, quality int")
    quality = by_id(quality_crf.judge(df, labels))
    mixed, shards = by_id(mixing.balance(df)), by_id(sharding.shard(df))
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        assert quality[i].n_words == len(w) == mixed[i]["size"] and quality[i].word_chars == sum(map(len, w))
        b = (t or "").encode()
        assert shards[i]["size"] == len(b) + 8 and shards[i].text_crc32 == zlib.crc32(b)
    assert quality[0].n_lines == 5500 and len({shards[i].shard for i in range(3)}) == 3


def test_near_copies_and_passages(table):
    df, texts = table
    near = by_id(order_minhash.classes(df))
    assert [near[i].class_id for i in range(7)] == [0, 0, 2, 3, 4, 5, 6] and near[0].n_links == near[1].n_links == 1
    removed = by_id(substring_dedup.judge(df))
    assert removed[2].n_removed == removed[3].n_removed == 60
    kept = WORD.findall(texts[3])[60:]
    assert removed[3].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    # the copies share all but what lies around their two differences
    assert removed[0].n_removed == removed[1].n_removed == 220_000 - 2
    kept = [w for i, w in enumerate(WORD.findall(texts[1])) if i in (1000, 150_000)]
    assert removed[1].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest() and kept == ["changed", "here"]


def test_licenses_and_languages(table):
    df, _ = table
    assert {(r.doc_id, r.license, r.containment) for r in license_scan.scan(df).collect() if r.license == "MIT"} == {(2, "MIT", 1.0)}
    got = by_id(language_id.predict(df))
    assert got[0].lang_pred in ("de", "en") and got[4].lang_pred == got[5].lang_pred == "und" and len(got) == 7


@pytest.mark.skipif(not Path(MODEL).exists(), reason="no vocabulary")
def test_pieces(table):
    df, texts = table
    got = by_id(sentencepiece_codec.encode(df, model=MODEL))
    assert all(got[i].round_trip for i, t in enumerate(texts) if t is not None)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load(MODEL))
    assert np.array_equal(np.frombuffer(codec.encode(texts[2]), np.int32), np.array(got[2].ids))
