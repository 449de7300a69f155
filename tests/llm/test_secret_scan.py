"""Secret scans against Python's regular expressions and plain counts of owners."""

import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from clickloom.llm import secret_scan

from .tables import SCHEMA, documents

PATTERNS = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ("opaque", re.compile(r"[A-Za-z0-9_+=-]{24,}"), 0, 24),
]


def plain_spans(text):
    """(start, kind, end, value) of the base kinds and of opaque values that overlap none of those."""
    found = []
    for k, (name, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            good = len(m[group]) >= least
            if name == "opaque":
                good = good and all(len(re.findall(c, m[0])) >= 3 for c in ("[0-9]", "[A-Z]", "[a-z]"))
                good = good and not any(a < m.end() and m.start() < b for a, j, b, _ in found if j < 3)
            if good:
                found.append((m.start(), k, m.end(), m[group]))
    return sorted(found)


def test_secrets(spark):
    empty = spark.createDataFrame([], SCHEMA)
    key = "Zx9" + "aB3" * 9
    texts = [
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é', "PassWord: hunter22 api_key=short apikey=abcdef", "AKIA" + "A1" * 10 + " AKIASHORT", None, "",
        "ſecret: abcdefgh secret: \"token: abcdef\"", f"see {key} here", *["password = example123"] * 5,
    ]
    rows = {r["doc_id"]: r for r in secret_scan.secret_spans(documents(spark, texts)).collect()}
    digest = lambda *s: hashlib.sha256(",".join(s).encode()).hexdigest()
    assert rows[0]["base_sha256"] == digest("assign:0:49", "hex:9:49") and rows[0]["n_hex"] == rows[0]["n_assign"] == 1
    assert rows[1]["base_sha256"] == digest("assign:0:18", "assign:33:46") and rows[2]["spans"] == "access:0:24"
    assert rows[3]["base_sha256"] == rows[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[5]["n_assign"] == 0 and rows[6]["spans"] == f"opaque:4:{4 + len(key)}"
    assert [(rows[i]["n_live"], rows[i]["n_example"]) for i in (0, 7, 11)] == [(2, 0), (0, 1), (0, 1)]
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(documents(spark, texts)).collect()}
    assert masked[0] == '[SECRET]" é' and masked[6] == "see [SECRET] here" and masked[7] == texts[7] and masked[3] is None and len(masked) == len(texts)
    assert secret_scan.secret_spans(empty).count() == 0 and secret_scan.mask_secrets(empty).count() == 0


def test_against_plain_scans_and_counts(spark):
    rng = np.random.default_rng(12)
    values = ["0123456789abcdef" * 2, "AKIA" + "Q7" * 9, "Zx9aB3aB3aB3aB3aB3aB3aB3aB3", "hunter2hunter2", "AKIASHORT", "deadbeef", "é漢字"]
    marks = ["token = ", "Api_Key:'", 'PASSWORD":"', "secret=", "", " ", "x", "\n", "token=token: "]
    texts = ["".join(str(rng.choice(marks)) + str(rng.choice(values)) + str(rng.choice([" ", "'", ",", ""])) for _ in range(int(n))) for n in rng.integers(0, 7, 120)]
    texts += ["pad " * 300_000 + "token = lonesecret99", None]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 2}", 0, 0.0, "r", 0, "w") for i, t in enumerate(texts)]
    rows.append((500, "token = threeowners1 secret=onlyoneowner", "en", "s0", 0, 0.0, "r", 0, "w"))
    rows += [(501 + i, "token = threeowners1", "en", f"t{i}", 0, 0.0, "r", 0, "w") for i in range(2)]
    rows += [(510 + i, "secret=onlyoneowner", f"l{i}", "s0", 0, 0.0, "r", 0, "w") for i in range(9)]  # many repositories of one owner
    rows += [(520 + i, "secret=twoownersmany", f"l{i}", f"u{i % 2}", 0, 0.0, "r", 0, "w") for i in range(8)]
    owners, places = defaultdict(set), defaultdict(set)
    for r in rows:
        for _, _, _, value in plain_spans(r[1]):
            owners[value].add(r[3])
            places[value].add((r[3], r[2]))
    example = {v for v in owners if len(owners[v]) >= 3 or (len(owners[v]) == 2 and len(places[v]) >= 6)}
    assert {"threeowners1", "twoownersmany"} <= example and "onlyoneowner" not in example
    got = {r["doc_id"]: r for r in secret_scan.secret_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        spans, names = plain_spans(r[1]), [n for n, *_ in PATTERNS]
        joined = lambda found: ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in found)
        base = [x for x in spans if x[1] < 3]
        row = got[r[0]]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(x[1] == k for x in base) for k in range(3)]
        assert row["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert row["spans"] == joined([x for x in spans if x[1] < 3 or x[3] not in example])
        assert (row["n_live"], row["n_example"]) == (sum(x[3] not in example for x in spans), sum(x[3] in example for x in spans))


def test_many_findings_in_one_text(spark):
    """Spans, overlaps and masks of thousands of findings, in a time that does not grow with their square."""
    rng = np.random.default_rng(15)
    lines = []
    for i in range(6000):
        digest = hashlib.md5(str(i).encode()).hexdigest()
        lines.append([f"é{digest}", f"token = {digest}Zx", f"Zx9aB3{digest}QRS", f"AKIA{digest.upper()}", "x" * int(rng.integers(40))][i % 5])
    text = "\n".join(lines)
    docs = documents(spark, [text, "no finding", "x" * 3000 + "token = lonesecret99" + "é" * 3000 + "secret:abcdefgh"])
    rows = {r["doc_id"]: r for r in secret_scan.secret_spans(docs).collect()}
    want = plain_spans(text)
    assert rows[0]["spans"] == ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b, _ in want) and len(want) > 5000
    found = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(docs).collect()}
    covered = np.zeros(len(text) + 1, bool)
    for a, _, b, _ in want:
        covered[a:b] = True
    plain, at = [], 0
    for a, _, b, _ in want:
        if a >= at:
            plain += [text[at:a], "[SECRET]"]
        at = max(at, b)
    assert found[0] == "".join(plain) + text[at:]
    assert found[1] == "no finding" and found[2] == "x" * 3000 + "[SECRET]" + "é" * 3000 + "[SECRET]"


def test_running_values_of_any_number(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        frame = spark.createDataFrame([([int(x) for x in np.random.default_rng(n).integers(-9, 9, n)],)], "v array<int>")
        found = frame.select(secret_scan.running(F.col("v"), F.lit(0), lambda a, b: (a + b).cast("int")).alias("r"), "v").first()
        assert found["r"] == list(np.cumsum(found["v"], dtype=int))
