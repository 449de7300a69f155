"""License scans: base phrases against plain counting, automata against plain matching of regions."""

import re

import numpy as np

from clickloom.llm import licenses

from .tables import SCHEMA, documents

MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)


def test_licenses(spark):
    empty, mit = spark.createDataFrame([], SCHEMA), "The MIT License. Copyright (c) 2020 Some Body & Sons. " + MIT
    texts = [
        "x Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0 and the gnu General Public-License version 3", mit, mit.replace("restriction", "limits"),
        None, "", "mit licenses, emit license", "acc by", "é apache\nLICENSE é",
    ]
    rows = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    got = [(rows[i]["n_words"], rows[i]["n_base"], rows[i]["first_word"], rows[i]["last_word"], rows[i]["base_labels"]) for i in range(len(texts))]
    assert got[0] == (9, 1, 4, 4, "apache") and got[4] == got[5] == (0, 0, None, None, "") and got[6][1] == got[7][1] == 0 and got[8] == (4, 1, 1, 1, "apache")
    assert got[1][1:] == (2, 2, 9, "cc-by,gpl")
    assert rows[0]["labels"] == "Apache-2.0-notice,apache" and rows[1]["labels"] == "CC-BY-NC-notice,GPL-3.0-notice,cc-by,gpl"
    assert "MIT" in rows[2]["labels"].split(",") and rows[2]["score"] > 0.9 and "MIT" not in rows[3]["labels"].split(",")
    assert licenses.license_scan(empty).count() == 0


def test_automaton_regions():
    a = licenses.Automaton("<<opt>> may be <<end>> must stand <<var 2>> then end")
    accepted = ["must stand then end", "may be must stand then end", "must stand x then end", "must stand x y then end"]
    refused = ["must stand x y z then end", "may must stand then end", "must stand then", "must then end"]
    assert [a.longest(t.split(), 0) == len(t.split()) for t in accepted + refused] == [True] * 4 + [False] * 4


def wording(name, fill="x"):
    """The text of a template with all optional words and one word for each replaceable region."""
    return re.sub(r"<<opt>> | ?<<end>>", "", re.sub(r"<<var \d+>>", fill, licenses.TEMPLATES[name] + " ")).strip()


def labels(text):
    return licenses.scan_text(text)[5].split(",")


def test_full_texts_are_told_apart():
    for name in licenses.TEMPLATES:
        found = labels(f"something before; {wording(name)}. Something after")
        assert name in found, name
        full = [x for x in found if not x.endswith("-notice") and x[0].isupper()]
        assert full in ([name], []), (name, full)
    two, three = wording("BSD-2-Clause"), wording("BSD-3-Clause")
    assert "BSD-2-Clause" not in labels(three) and "BSD-3-Clause" not in labels(two)
    assert "MIT" not in labels(MIT[: MIT.index("THE SOFTWARE IS")]) and "MIT" not in labels(MIT.replace("TORT", "TORTS"))
    assert "BSD-3-Clause" in labels(three.replace("provided by x as is", "provided by the copyright holders and contributors as is"))


def plain_match(marks, words):
    """Whether a template, as a list of marks, matches exactly these words, by trying every choice of each region."""
    if not marks:
        return not words
    first, rest = marks[0], marks[1:]
    if first == "<<opt>>":
        depth, i = 1, 0
        while depth:
            depth += (rest[i] == "<<opt>>") - (rest[i] == "<<end>>")
            i += 1
        return plain_match(rest[: i - 1] + rest[i:], words) or plain_match(rest[i:], words)
    if first.startswith("<<var"):
        return any(plain_match(rest, words[n:]) for n in range(min(int(first[6:-2]), len(words)) + 1))
    return bool(words) and words[0] == first and plain_match(rest, words[1:])


def test_automata_against_plain_matching():
    rng = np.random.default_rng(3)
    for _ in range(150):
        template, depth = ["a"], 0
        for _ in range(int(rng.integers(1, 8))):
            kind = rng.integers(0, 5)
            if kind == 0 and depth < 2:
                template += ["<<opt>>", str(rng.choice(list("abc")))]
                depth += 1
            elif kind == 1 and depth:
                template.append("<<end>>")
                depth -= 1
            elif kind == 2:
                template.append(f"<<var {rng.integers(1, 4)}>>")
            else:
                template.append(str(rng.choice(list("abc"))))
        template += ["<<end>>"] * depth
        automaton, marks = licenses.Automaton(" ".join(template)), re.findall(r"<<[^>]*>>|\S+", " ".join(template))
        for _ in range(20):
            words = [str(w) for w in rng.choice(list("abc"), int(rng.integers(0, 9)))]
            ends = [n for n in range(len(words) + 1) if plain_match(marks, words[:n])]
            assert automaton.longest(words, 0) == max(ends, default=-1), (template, words)


def test_base_against_plain_counting(spark):
    rng = np.random.default_rng(5)
    bits = "gnu general public license apache license cc by mit license MIT License GNU é CC lic ense".split()
    texts = ["".join(str(rng.choice(bits)) + str(rng.choice([" ", "\n", ", ", "-", "é", "_"])) for _ in range(int(n))) for n in rng.integers(0, 60, 150)]
    texts += [None, "", "word " * 200_000 + "mit license"]
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(at, label) for p, label in phrases.items() for at in range(len(w)) if w[at : at + len(p.split())] == p.split()]
        starts = [at for at, _ in places]
        expected = (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == expected
        assert set(filter(None, expected[4].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def full_text(name):
    return licenses._wording(licenses.FULL_TEXTS[name][0])


def test_whole_license_files():
    for name in licenses.FULL_TEXTS:
        text = full_text(name)
        assert name in labels("Some project.\n\n" + text + "\nMore."), name
        assert name in labels(" ".join(text.split()).upper()), name  # set in one line
        assert name in labels(re.sub(r"(?m)^(\s*)\(?[a-e][).] ", r"\1* ", text)), name  # other list marks
        _, begin, end = licenses.FULL_TEXTS[name]
        terms = text[text.index(begin) : text.index(end) if end else None]  # the notes behind them hold a file header, which has a label of its own
        assert name in labels(terms), name
        for word in ("permission", "damages", "version"):
            for m in [*re.finditer(rf"\b{word}\b", terms)][:3]:
                assert name not in labels(terms[: m.start()] + "something" + terms[m.end() :]), (name, word)
        assert name not in labels(text[: len(text) // 2]), name
    families = {n: {x for x in labels(full_text(n)) if x in licenses.FULL_TEXTS} for n in licenses.FULL_TEXTS}
    assert families == {n: {n} for n in families}


def test_file_header_of_the_mozilla_license():
    head = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
    head += " * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint x;"
    assert "MPL-2.0" in labels(head) and "MPL-2.0" not in labels(head.replace("was not", "was"))
    apache = wording("Apache-2.0").replace("http https www", "https")
    assert "Apache-2.0" in labels(apache) and "Apache-2.0" in labels(apache.replace("https", "http www"))
    assert labels("Licensed under CC0 1.0 Universal") == ["CC0-1.0-notice"]


def test_many_beginnings_of_a_license():
    begins = "terms and conditions for copying distribution " * 20_000
    assert labels(begins) == [""]
    assert "GPL-2.0" in labels(begins + full_text("GPL-2.0"))
