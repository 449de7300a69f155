"""Toxicity scores: lexicon and features against plain versions, and what they find."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import toxicity

from .tables import SCHEMA, documents, sentence

ODDS = {b"idiot=": 5.0, b"moron": 2.5, b"tras": 1.0, "réeux".encode(): 4.0}
KNOWN = toxicity.Lexicon(ODDS)
WORD = rb"[a-z\x80-\xff]+"


def feature(text, name):
    return toxicity.features([text], KNOWN)[0][toxicity.FEATURES.index(name)]


def weight(word):
    """The largest log-odds of a word and of its beginnings of three to eight bytes."""
    return max([ODDS.get(word + b"=", 0.0)] + [ODDS.get(word[:n], 0.0) for n in range(3, 9) if n < len(word)])


def plain(text):
    """The features of one text, word by word."""
    if not text:
        return {name: 0.0 for name in toxicity.FEATURES}
    raw, low = text.encode(), text.lower().encode()
    words = re.findall(WORD, low)
    n, size = max(1, len(words)), len(raw)
    per, w = 100 / n, [weight(x) for x in words]
    second = [x.decode() in toxicity.SECOND for x in words]
    leet = bytes.maketrans(b"013457@$!|+", b"oieastasiit")
    disguised = obfuscated = 0
    for token in re.split(rb"[ \t\n\v\f\r]+", low):
        inner = any(
            c in b"0123456789@$!|+*" and (
                (97 <= p <= 122 and (97 <= q <= 122 or q in b"0123456789@$!|+*")) or (not (97 <= p <= 122 or p > 127) and 97 <= q <= 122)
            )
            for p, c, q in zip(b" " + token, token, token[1:] + b" ")
        )
        if inner:
            disguised += sum(weight(m.replace(b"*", b"").translate(leet)) >= 3.5 for m in toxicity.DISGUISED.findall(token))
            obfuscated += len(toxicity.OBFUSCATED.findall(token))
    apart = re.findall(rb"(?<![a-z\x80-\xff])(?:[a-z][ .\-_*]){3,}[a-z](?![a-z\x80-\xff])", low)
    disguised += sum(weight(re.sub(rb"[^a-z]", b"", m)) >= 3.5 for m in apart)
    bands = [sum(x >= 3.5 for x in w), sum(2 <= x < 3.5 for x in w), sum(0 < x < 2 for x in w)]
    distinct = len({x for x, y in zip(words, w) if y})
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    return {
        "strong": bands[0] * per, "middle": bands[1] * per, "weak": bands[2] * per,
        "distinct": min(distinct + disguised, 12), "distinct_share": distinct / n, "hits": min(sum(bands) + disguised, 12),
        "surest": max(w, default=0.0), "odds": sum(w) / n, "disguised": disguised * per,
        "near_second": sum(any(second[max(0, i - 6) : i + 7]) for i, y in enumerate(w) if y) * per, "second": any(second),
        "capitals": count(range(65, 91)) / size, "capital_words": len(re.findall(rb"(?<![A-Za-z\x80-\xff])[A-Z]{3,}(?![A-Za-z\x80-\xff])", raw)) * per,
        "exclaim": count(b"!") * per, "question": count(b"?") * per, "other_punctuation": count(b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~") / size,
        "digits": count(b"0123456789") / size, "obfuscated": obfuscated * per, "apart": len(apart) * per,
        "repeated_letters": bool(re.search(rb"([a-z])\1\1", low)), "log_words": math.log1p(n),
    }


def corpus(spark):
    rng = np.random.default_rng(2)
    # every fourth text holds insults; half of those are compounds that no other text holds
    own = lambda i: str(i).translate(str.maketrans("0123456789", "abcdefghij"))
    insult = lambda i: " you stupid idiot " if i % 8 else f" the flurb{own(i)}x flurb{own(i)}y flurb{own(i)}z "
    texts = [sentence(rng, 60) + (insult(i) + sentence(rng, 5) if i % 4 == 0 else "") for i in range(400)]
    docs = documents(spark, [*texts, None, "", "you are an 1d10t, a st*pid m0ron"])
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(300)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    return texts, docs, labels


def test_scores(spark):
    _, docs, labels = corpus(spark)
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels, trees=5).collect()}
    assert len(rows) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(rows[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    kept = toxicity.drop_toxic(docs, labels, trees=5)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(400) if i % 4}


def test_repeated_ids_and_ties(spark):
    _, docs, labels = corpus(spark)
    twice = docs.union(docs.where("doc_id = 4"))
    train_rows = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels, trees=3, max_train=120).collect()}
    rows = toxicity.toxicity_scores(twice, labels.union(labels), trees=3, max_train=120).collect()
    assert len(rows) == 404 and all(r["score"] == train_rows[r["doc_id"]] for r in rows)


def test_lexicon_against_counts(spark):
    texts, docs, labels = corpus(spark)
    train = docs.join(labels, "doc_id").select("text", F.col("toxic").cast("double").alias("label"), (F.col("doc_id") % 5).cast("int").alias("fold"))
    found = toxicity.learn_lexicons(train)
    for fold in range(6):
        rows = [(t, i % 4 == 0) for i, t in enumerate(texts[:300]) if i % 5 != fold]
        counts: dict = {}
        for text, toxic in rows:
            words = set(re.findall(WORD, text.lower().encode()))
            for e in {w + b"=" for w in words} | {w[:n] for w in words for n in range(3, 9) if n < len(w)}:
                counts.setdefault(e, [0, 0])[0 if toxic else 1] += 1
        nt = sum(x for _, x in rows)
        no = len(rows) - nt
        expected = {}
        for e, (t, o) in counts.items():
            odds = math.log((t + 0.5) / (nt + 1)) - math.log((o + 0.5) / (no + 1))
            if t >= 3 and odds - toxicity.DOUBT * math.sqrt(1 / (t + 0.5) + 1 / (o + 0.5)) > math.log(2):
                expected[e] = odds
        assert found[fold].keys() == expected.keys() and all(abs(found[fold][e] - x) < 1e-12 for e, x in expected.items())
    assert {b"idiot=", b"flurb", b"flur"} <= found[-1].keys()
    least = toxicity.learn_lexicons(train, max_entries=3)
    assert all(len(x) <= 3 for x in least)


def test_features_against_the_plain_version():
    rng = np.random.default_rng(4)
    bits = ["idiot", "IDIOT!", "1d10t", "moronic,", "trash", "RÉEUXment", "réeux", "you", "You're", "tu", "i d i o t", "x.y.z.w", "a b", "AAA", "aaargh", "v2", "he11o", "pa$$word",
            "50%", "!!", "?", "é", "—", "\n", "\t\t", "end.", "don't", "DEADbeef01", "m*o*r*o*n*s", "İx", "ß", "|", "one | two", "x1y2z3", "00ab00"]
    texts = [" ".join(rng.choice(bits, int(n))) for n in rng.integers(1, 40, 300)]
    texts += [sentence(rng, 50), None, "", " ", "idiot", "You IDIOT! you moronic trash? AAA trash, is it not: idiot...", "x" * 5000, "you " * 9 + "idiot"]
    for at_once in (toxicity.AT_ONCE, 100):
        toxicity.AT_ONCE, before = at_once, toxicity.AT_ONCE
        found = toxicity.features(texts, KNOWN)
        toxicity.AT_ONCE = before
        for t, row in zip(texts, found):
            for name, value in plain(t).items():
                assert row[toxicity.FEATURES.index(name)] == pytest.approx(float(value), abs=1e-9), (name, t)


def test_features_see_disguise():
    assert feature("what an 1d10t", "disguised") > 0 and feature("what an i d i o t here", "disguised") > 0 and feature("the year 2019", "disguised") == 0
    assert feature("an id1ot", "obfuscated") > 0 and feature("v2 of it", "obfuscated") == 0


def test_long_text_is_read_whole():
    assert feature("fine words here " * 100_000 + "idiot", "surest") == 5.0
    assert feature("x" * 1_000_000, "surest") == 0.0 and feature("a " * 200_000, "hits") == 0.0


def test_without_labels(spark):
    docs, empty = documents(spark, ["a b", None, ""]), spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(i, i % 2, 1) for i in range(9)], "doc_id long, toxic int, quality int")
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()} == {0.0}
    for known in (labels, some):
        assert toxicity.toxicity_scores(empty, known).count() == 0
        kept = toxicity.drop_toxic(empty, known)
        assert kept.count() == 0 and kept.columns == empty.columns
