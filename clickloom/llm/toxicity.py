"""Toxicity scores: gradient-boosted trees over dense features with isotonic calibration.

The lexicon is learned from the training labels: for each whole word and each word beginning of
``STEMS`` bytes it is counted in how many toxic and in how many other documents it occurs, and
entries whose log-odds are above ``LEAST_ODDS`` beyond doubt (``DOUBT`` standard errors) stay, the ``max_entries``
surest of them.  Beginnings catch inflected and compound words that no training document holds.

Features of a whole text (``FEATURES``): densities of lexicon words in three bands of their
log-odds, of distinct ones and of disguised spellings, nearness of second-person words to lexicon words, shares
of capitals, of words in capitals, of punctuation, and rates of obfuscation
(letters replaced by digits or signs, letters drawn apart).  Trees are fitted by
``pyspark.ml`` on training labels; one fifth of those (by a hash of the id) is
kept from the trees and calibrates their margin by isotonic regression.  So that no row's own label reaches its
features, a training row's features come from the lexicon of the other four fifths; other rows use the lexicon of all.
A share of one thousandth of the trees' own probability is mixed in, so that equal steps
of the isotonic fit keep their order.

Training uses at most ``max_train`` labelled documents, those with the least hash of the
id; this bounds the broadcast that picks their texts (16 bytes each).  Everything else
covers all documents.

Defined cases: a null or empty text has all features 0 and a score like any other; an
id labelled more than once counts as toxic if any label says so; of a training id that several rows carry the least text is
learned; a null id is never
trained on and is not held out; repeated rows give a row each; an empty table
gives an empty result; without labels of both kinds every score is the share of toxic
labels (0 without labels).  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, shared_dir, staged

SECOND = "you your yours yourself u ur ya youre tu te toi ton ta tes vous votre du dich dir dein deine ihr euch usted tus ti".split()
LEET = bytes.maketrans(b"013457@$!|+", b"oieastasiit")
DISGUISED = re.compile(rb"(?<![a-z0-9\x80-\xff])(?:[a-z]++[0-9@$!|+*]|[0-9@$|+]++[a-z])[a-z0-9@$!|+*]*+")
OBFUSCATED = re.compile(rb"(?<![a-z\x80-\xff])[a-z]++(?:[0-9@$!|+*]++[a-z]++)++(?![a-z\x80-\xff])")
FEATURES = (
    "strong middle weak distinct distinct_share hits surest odds disguised near_second second capitals capital_words exclaim question "
    "other_punctuation digits obfuscated apart repeated_letters log_words"
).split()
#: Words are runs of letters a to z and of bytes above 127, after lower-casing.
WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Lengths in bytes of the word beginnings that may enter the lexicon; an entry for a whole word ends in WHOLE.
STEMS, WHOLE = range(3, 9), b"="
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 6
#: An entry occurs in so many toxic documents at least, and its log-odds less DOUBT standard errors exceed LEAST_ODDS.
LEAST_DOCUMENTS, LEAST_ODDS, DOUBT = 3, math.log(2.0), 2.33
STRONG, MIDDLE = 3.5, 2.0
FOLDS = 5
FLUSH = 200_000
#: Bytes of text whose features are taken at once (a longer text by itself).
AT_ONCE = 1 << 20

_POWERS = np.cumprod(np.full(1 << 12, 0x100000001B3, np.uint64))  # longer words are told apart by these bytes and their length
_END = np.uint64(0x9E3779B97F4A7C15)


def _marks(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_SMALL, _CAPITAL = _marks(bytes(range(97, 123))), _marks(bytes(range(65, 91)))
_LETTER = _SMALL | _marks(bytes(range(128, 256)))
_DIGIT, _SIGN, _APART = _marks(b"0123456789"), _marks(b"0123456789@$!|+*"), _marks(b" .-_*")
_SPACE = _marks(b" \t\n\v\f\r")
_PUNCTUATION = _marks(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) & ~_marks(b"!?")


def entries(word: bytes) -> Iterator[bytes]:
    """The lexicon entries that a word meets: itself and its beginnings."""
    yield word + WHOLE
    for n in STEMS:
        if n < len(word):
            yield word[:n]


def _starts(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin, and their lengths."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2] - edges[::2]


def _hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the beginnings of each word by STEMS (of what follows too, where the word is shorter), and of the whole words."""
    if not len(start):
        return [start.astype(np.uint64)] * len(STEMS), start.astype(np.uint64)
    padded = np.concatenate([raw, np.zeros(STEMS[-1], np.uint8)])
    total, stems = np.zeros(len(start), np.uint64), []
    for i in range(STEMS[-1]):
        total = total + padded[start + i] * _POWERS[i]
        if i + 1 in STEMS:
            stems.append(total)
    apart = np.diff(start, append=len(raw))  # each word with what follows it, whose terms are zero
    at = np.arange(start[0], len(raw)) - np.repeat(start, apart)
    terms = raw[start[0] :] * _POWERS[np.minimum(at, len(_POWERS) - 1)]
    terms[at >= np.repeat(length, apart)] = 0
    return stems, np.add.reduceat(terms, start - start[0]) + _END * length.astype(np.uint64)


class _Table:
    """Values by hash; a bit for each leading 16 bits passes most of the absent ones by."""

    def __init__(self, values: dict[int, float]):
        self.keys = np.array(sorted(values), np.uint64)
        self.values = np.array([values[k] for k in sorted(values)])
        self.there = np.zeros(1 << 16, bool)
        self.there[self._lead(self.keys)] = True

    def _lead(self, h: np.ndarray) -> np.ndarray:
        return (h * _END >> np.uint64(48)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``h`` that are in the table, and their values."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.flatnonzero(self.there[self._lead(h)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[place] == h[at]
        return at[good], self.values[place[good]]


def _hash(word: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    return _hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))


class Lexicon:
    """Log-odds by entry; a word has the largest of the entries it meets, 0 where it meets none."""

    def __init__(self, odds: dict[bytes, float]):
        self.odds, self.heads = odds, {e.rstrip(WHOLE)[: STEMS[0]] for e in odds}
        self.whole = _Table({int(_hash(e[:-1])[1][0]): w for e, w in odds.items() if e.endswith(WHOLE)})
        stems = [{int(_hash(e)[0][n - STEMS[0]][0]): w for e, w in odds.items() if len(e) == n and not e.endswith(WHOLE)} for n in STEMS]
        self.stems = [_Table(x) for x in stems]
        self.second = _Table({int(_hash(w.encode())[1][0]): 1.0 for w in SECOND})

    def weight(self, word: bytes) -> float:
        if word[: STEMS[0]] not in self.heads:
            return 0.0
        return max((self.odds.get(e, 0.0) for e in entries(word)), default=0.0)

    def weights(self, stems: list[np.ndarray], whole: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The log-odds of hashed words."""
        found = np.zeros(len(whole))
        at, w = self.whole.find(whole)
        found[at] = w
        for n, h, table in zip(STEMS, stems, self.stems):
            at, w = table.find(h)
            longer = length[at] > n
            found[at[longer]] = np.maximum(found[at[longer]], w[longer])
        return found


def _features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """The features of texts none of which is empty, taken together."""
    shown = [t.encode("utf-8", "replace") for t in texts]
    lowered = [t.lower().encode("utf-8", "replace") for t in texts]
    n_texts = len(texts)

    def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b" ".join(parts) + b" ", np.uint8), np.cumsum([len(p) + 1 for p in parts])

    raw, ends = joined(shown)
    sizes = np.diff(ends, prepend=0) - 1
    sums = lambda marks: np.add.reduceat(marks[raw].astype(np.int64), ends - sizes - 1)
    capital = sums(_CAPITAL)
    start, length = _starts(_CAPITAL[raw])
    around = np.concatenate([[0], raw, [0]])
    letter = _LETTER | _CAPITAL
    alone = (length >= 3) & ~letter[around[start]] & ~letter[around[start + length + 1]]
    per_text = lambda at, upto, w=None: np.bincount(np.searchsorted(upto, at, "right"), w, n_texts)
    shouted = per_text(start[alone], ends)
    exclaim, question, punctuation, digits = sums(_marks(b"!")), sums(_marks(b"?")), sums(_PUNCTUATION), sums(_DIGIT)

    low, upto = joined(lowered)
    start, length = _starts(_LETTER[low])
    text = np.searchsorted(upto, start, "right")
    stems, whole = _hashes(low, start, length)
    weight = lexicon.weights(stems, whole, length)
    n_words = np.bincount(text, minlength=n_texts)
    hit = np.flatnonzero(weight)
    second = lexicon.second.find(whole)[0]
    counted = lambda chosen, w=None: np.bincount(text[chosen], w, n_texts)
    strong, middle = counted(hit[weight[hit] >= STRONG]), counted(hit[(weight[hit] < STRONG) & (weight[hit] >= MIDDLE)])
    weak, odds, seconds = counted(hit[weight[hit] < MIDDLE]), counted(hit, weight[hit]), counted(second)
    surest = np.zeros(n_texts)
    np.maximum.at(surest, text[hit], weight[hit])
    pairs = np.unique(np.stack([text[hit].astype(np.uint64), whole[hit]], axis=1), axis=0) if len(hit) else np.zeros((0, 2), np.uint64)
    distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=n_texts)
    # places of words, with gaps between texts, so that nothing is near across them
    place = np.arange(len(start)) + text * (NEAR + 1)
    follows = np.searchsorted(place[second], place[hit] - NEAR)
    near = np.zeros(len(hit), bool)
    if len(second) and len(hit):
        inside = follows < len(second)
        near[inside] = place[second][follows[inside]] <= place[hit][inside] + NEAR
    near = counted(hit[near])

    # words with signs for letters: the tokens around them are looked at one by one
    before, after = np.concatenate([[32], low[:-1]]), np.concatenate([low[1:], [32]])
    sign = np.flatnonzero(_SIGN[low] & ((_SMALL[before] & (_SMALL[after] | _SIGN[after])) | (~_LETTER[before] & _SMALL[after])))
    disguised, obfuscated = np.zeros(n_texts), np.zeros(n_texts)
    if len(sign):
        begin, size = _starts(~_SPACE[low])
        joint = low.tobytes()
        own = np.unique(np.searchsorted(begin, sign, "right") - 1)
        for k, a, b in zip(np.searchsorted(upto, begin[own], "right").tolist(), begin[own].tolist(), (begin + size)[own].tolist()):
            token = joint[a:b]
            for word in DISGUISED.findall(token):
                disguised[k] += lexicon.weight(word.translate(LEET, b"*")) >= STRONG
            obfuscated[k] += len(OBFUSCATED.findall(token))
    # letters drawn apart: four or more words of one letter with one sign between
    single = (length == 1) & _SMALL[low[start]] if len(start) else np.zeros(0, bool)
    link = single[:-1] & single[1:] & (np.diff(start) == 2) & _APART[low[start[:-1] + 1]] & (text[:-1] == text[1:]) if len(start) > 1 else np.zeros(0, bool)
    begin, size = _starts(link)
    apart = np.zeros(n_texts)
    for i, n in zip(begin[size >= 3], size[size >= 3]):
        apart[text[i]] += 1
        disguised[text[i]] += lexicon.weight(low[start[i : i + n + 1]].tobytes()) >= STRONG
    drawn = np.flatnonzero(_SMALL[low[:-2]] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])) if len(low) > 2 else np.zeros(0, np.int64)
    drawn = per_text(drawn, upto) > 0

    words = np.maximum(n_words, 1)
    per = 100 / words
    hits = strong + middle + weak + disguised
    columns = dict(
        strong=strong * per, middle=middle * per, weak=weak * per, distinct=np.minimum(distinct + disguised, 12), distinct_share=distinct / words,
        hits=np.minimum(hits, 12), surest=surest, odds=odds / words, disguised=disguised * per, near_second=near * per, second=seconds > 0,
        capitals=capital / sizes, capital_words=shouted * per, exclaim=exclaim * per, question=question * per, other_punctuation=punctuation / sizes,
        digits=digits / sizes, obfuscated=obfuscated * per, apart=apart * per, repeated_letters=drawn, log_words=np.log1p(words),
    )
    return np.stack([columns[name] for name in FEATURES], axis=1).astype(np.float64)


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """The dense features of each text, in the order of ``FEATURES``."""
    found = np.zeros((len(texts), len(FEATURES)))
    group: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if t:
            group.append(i)
            held += len(t)
        if group and (held >= AT_ONCE or i == len(texts) - 1):
            found[group] = _features([texts[j] for j in group], lexicon)
            group, held = [], 0
    return found


def log_odds(toxic: float, other: float, n_toxic: float, n_other: float) -> tuple[float, float]:
    """Log-odds of an entry by documents, and how many of them are beyond doubt."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
    return odds, odds - DOUBT * math.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def _sure(toxic: Column, other: Column, n_toxic: int, n_other: int) -> Column:
    """The log-odds beyond doubt as a column; null where they do not suffice."""
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((other + 0.5) / (n_other + 1))
    sure = odds - DOUBT * F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return F.when((toxic >= LEAST_DOCUMENTS) & (sure > LEAST_ODDS), sure)


def entry_counts(train: DataFrame) -> DataFrame:
    """(entry, fold, toxic, other): documents of ``train`` (text, label, fold) by the lexicon entries they hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(found)
            entry, fold, label = zip(*keys) if keys else ((), (), ())
            times = [found[k] for k in keys]
            columns = [
                pa.array(entry, pa.binary()),
                pa.array(fold, pa.int32()),
                pa.array([t if x else 0 for t, x in zip(times, label)], pa.int64()),
                pa.array([0 if x else t for t, x in zip(times, label)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["entry", "fold", "toxic", "other"])

        for batch in batches:
            for text, label, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = set(WORD.findall((text.as_py() or "").lower().encode("utf-8", "replace")))
                found.update((e, fold, label > 0) for e in {e for w in words for e in entries(w)})
                if len(found) > FLUSH:
                    yield flush()
                    found = Counter()
        yield flush()

    partial = train.select("text", "label", "fold").mapInArrow(count, "entry binary, fold int, toxic long, other long")
    return partial.groupBy("entry", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicons(train: DataFrame, max_entries: int = 4096) -> list[dict[bytes, float]]:
    """Lexicons without each fold in turn, and last that of all of ``train`` (text, label, fold).

    The driver gets the ``max_entries`` surest entries alone.
    """
    size = np.zeros((2, FOLDS))
    for r in train.groupBy("fold", "label").agg(F.count("*").alias("n")).collect():
        size[int(r["label"] == 0), r["fold"]] += r["n"]
    every = size.sum(axis=1)
    of = lambda name, f: F.sum(F.when(F.col("fold") == f, F.col(name)).otherwise(0)).alias(f"{name}{f}")
    table = entry_counts(train).groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), *[of(k, f) for k in ("toxic", "other") for f in range(FOLDS)]
    )
    parts = [(F.lit(0), F.lit(0), 0.0, 0.0)] + [(F.col(f"toxic{f}"), F.col(f"other{f}"), size[0, f], size[1, f]) for f in range(FOLDS)]
    sure = [_sure(F.col("toxic") - t, F.col("other") - o, every[0] - nt, every[1] - no) for t, o, nt, no in parts]
    rows = table.withColumn("sure", F.greatest(*sure)).where("sure is not null").orderBy(F.desc("sure"), "entry").limit(max_entries).collect()
    found: list[dict[bytes, float]] = [{} for _ in range(FOLDS + 1)]
    for r in rows:
        for f in range(FOLDS + 1):
            t, o = r["toxic"] - (r[f"toxic{f}"] if f < FOLDS else 0), r["other"] - (r[f"other{f}"] if f < FOLDS else 0)
            n = every - size[:, f] if f < FOLDS else every
            odds, least = log_odds(t, o, n[0], n[1])
            if t >= LEAST_DOCUMENTS and least > LEAST_ODDS:
                found[f][bytes(r["entry"])] = odds
    return found


def with_features(docs: DataFrame, text: Column, lexicons: list[dict[bytes, float]], fold: Column | None = None) -> DataFrame:
    """``docs`` with the vector column ``__features``, from the lexicon numbered ``fold`` (the last where none is given)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def of_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = [Lexicon(x) for x in shared.value]
        for texts, folds in batches:
            found = np.zeros((len(texts), len(FEATURES)))
            for f in folds.unique():
                own = np.flatnonzero(folds.to_numpy() == f)
                found[own] = features([texts.iloc[i] for i in own], known[f])
            yield pd.Series(list(found))

    of_batches.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    vector = F.pandas_udf(of_batches, "array<double>")(text.cast("string"), F.lit(-1) if fold is None else fold)
    return docs.withColumn("__features", array_to_vector(vector))


class ToxicityModel:
    """Lexicons, fitted trees and calibration; ``share`` stands for all of them where the labels are of one kind."""

    def __init__(self, lexicons, trees, isotonic, share: float):
        self.lexicons, self.trees, self.isotonic, self.share = lexicons, trees, isotonic, share

    def score(self, docs: DataFrame, text: Column) -> DataFrame:
        """Adds ``__score``."""
        if self.trees is None:
            return docs.withColumn("__score", F.lit(self.share))
        return self.of_features(with_features(docs, text, self.lexicons[-1:]))

    def of_features(self, docs: DataFrame) -> DataFrame:
        out = self.trees.transform(docs).withColumn("__margin", vector_to_array("__raw")[1])
        own = vector_to_array("__probability")[1]
        out = self.isotonic.transform(out)
        mixed = 0.999 * F.col("__calibrated") + 0.001 * own
        return out.withColumn("__score", F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0))).drop(
            "__features", "__raw", "__probability", "__prediction", "__margin", "__calibrated"
        )


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_train: int = 40_000, max_entries: int = 4096, trees: int = 20, depth: int = 4, seed: int = 7
) -> ToxicityModel:
    """Fit on the labelled documents whose id's crc32 does not leave remainder 1 when divided by 3."""
    spark = docs.sparkSession
    shared_dir(spark)
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("double").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id"), 3))
        .groupBy("id")
        .agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(FOLDS)).cast("int")
    train = staged(texts.join(F.broadcast(labelled), "id").groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("fold", fold), "labelled")
    n, toxic = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if toxic in (0, n):
        return ToxicityModel(None, None, None, toxic / n if n else 0.0)
    lexicons = learn_lexicons(train, max_entries)
    rows = staged(with_features(train, F.col("text"), lexicons, F.col("fold")).select("id", "label", "fold", "__features"), "features")
    few = rows.coalesce(4)  # at most max_train short rows, read many times
    fit, rest = few.where("fold > 0"), few.where("fold = 0")
    if fit.agg(F.count_distinct("label")).first()[0] < 2 or rest.count() < 20:
        fit = rest = few
    gbt = GBTClassifier(
        featuresCol="__features", labelCol="label", predictionCol="__prediction", maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=10, maxBins=64, seed=seed
    )
    gbt.setRawPredictionCol("__raw").setProbabilityCol("__probability")
    model = gbt.fit(fit.sortWithinPartitions("id"))
    margins = model.transform(rest).select("label", vector_to_array("__raw")[1].alias("__margin"))
    isotonic = IsotonicRegression(featuresCol="__margin", labelCol="label", predictionCol="__calibrated").fit(margins)
    return ToxicityModel(lexicons, model, isotonic, toxic / n)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text)."""
    model = fit_toxicity(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return model.score(rows, F.col("text")).select(
        "doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or more; all columns stay."""
    model = fit_toxicity(docs, labels, **options)
    rows = docs.select(F.struct("*").alias("row"))
    return model.score(rows, F.col("row.text")).where(F.col("__score") < threshold).select("row.*")
