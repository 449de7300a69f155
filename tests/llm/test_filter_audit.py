"""The filter audit against a row-by-row version."""

import re
from itertools import permutations

import numpy as np

from clickloom.llm.filter_audit import COUNTS, failed, filter_audit

from .tables import SCHEMA, documents, sentence


def brute(rows, labels):
    """(part, order, step) -> counts, filter by filter over each document."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and least[t] < i,
        }
        docs.append((lang or "", {x for x in fails if fails[x]}, *(i is not None and i in x for x in (good, toxic))))
    out = {}
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                earlier = sum(1 for d in mine if f in d[1]) - len(gone)
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), earlier, sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return out


def test_every_order_and_step(spark):
    rng = np.random.default_rng(3)
    texts = [sentence(rng, int(n)) + rng.choice(["", " $5", " ABCDEFGHIJ KLMNOP QRST"]) for n in rng.integers(1, 420, 40)]
    texts += [None, "", "", " \n\t", texts[0], texts[0], texts[7], "the " * 300, "the " * 300, "É ß \u3000 x\u00a0y" * 90, "x" * 300_000, "A#" * 1000]
    ids = [*range(100, 100 + len(texts) - 4), None, 3, 3, None]
    langs = [[None, "en", "", "de"][i % 4] for i in range(len(texts))]
    rows = [(i, t, x) for i, t, x in zip(ids, texts, langs)] + [(3, texts[0], "en"), (3, texts[0], "en"), (None, None, None)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(100, 130)] + [(101, None, 1), (101, 1, 0), (None, 1, 1), (3, 0, 1), (9, 1, 1)]
    docs = spark.createDataFrame([(*r, "a", 1, 1) for r in rows], "doc_id long, text string, lang string, part string, n long, bits int")
    found = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(rows, labels)
    assert len(found) == len(want) == 600 * len({x or "" for x in langs})
    for r in found:
        assert [r[c] for c in COUNTS] == want[r["part"], r["filter_order"], r["step"]]


def test_a_text_that_most_rows_share(spark):
    docs = documents(spark, ["copy of a text"] * 300 + ["another"] * 10)
    rows = filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [r["removed"] for r in rows] == [308, 2, 0, 0, 0]


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_filters_read_bytes_like_characters():
    assert failed("É".encode() * 97 + b"ABC") & 4 == 0 and failed("É".encode() * 96 + b"ABC") & 4
    assert failed("a\u00a0b ".encode() * 200) & 1 == 0
