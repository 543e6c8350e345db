"""The string kernel, its regression and the quality statistics against plain Python."""

import math
import re

import numpy as np

from tidemark.llm import langid, quality

MASK = (1 << 64) - 1
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
EN = ["The cat sat on the mat, and the dog barked.", "A house with three windows stands there", "we went down to the river yesterday", "What is the name of this street?", "They have bought some bread and butter"]
DE = ["Der Hund schläft unter dem großen Tisch", "Wir gehen morgen früh in die Stadt!", "ein Haus mit drei Fenstern und Garten", "Wie heißt diese Straße, bitte?", "Sie haben gestern Brot gekauft; und Milch"]


def grams(text):
    """One set of places for each order: letters; pairs and triples over letters and the blanks that follow letters."""
    code, after = [], False
    for c in text.lower():
        if c.isalpha():
            code.append(ord(c))
        elif after:
            code.append(32)
        after = c.isalpha()
    out = []
    for order, places in enumerate(langid.BUCKETS):
        found = set()
        for i in range(len(code) - order):
            h = 0
            for j in range(order + 1):
                h = (h + code[i + j] + 1) * SEEDS[j] & MASK
                h ^= h >> 29
            if order or code[i] != 32:
                found.add((h >> 20) % places)
        out.append(found)
    return out


def kernel(a, b):
    return sum(len(x & y) / math.sqrt(max(len(x), 1) * max(len(y), 1)) for x, y in zip(grams(a), grams(b), strict=True)) / len(langid.BUCKETS)


def test_blended_kernel():
    texts = [*EN, *DE, "", "  12 !", "é", "a", "ab  cd", "x" * 3000 + " y", "  lead, and trail .. "]
    bits, _ = langid.presence(texts)
    x = langid.normalised(bits).astype(float)
    want = np.array([[kernel(a, b) for b in texts] for a in texts])
    assert np.allclose(x @ x.T, want, atol=1e-5)
    assert [int(b.sum()) for b in bits] == [sum(map(len, grams(t))) for t in texts]


def test_ridge_over_landmarks():
    texts, names, each = EN + DE[:4], ["en"] * 5 + ["de"] * 4, 3
    model = langid.fit(langid.presence(texts)[0], names, landmarks=2 * each)
    marks = [*DE[:each], *EN[:each]]  # the first of each language
    k = np.array([[kernel(a, b) for b in marks] for a in texts])
    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[1.0 if n == name else -1.0 for name in ("de", "en")] for n in names])
    w = np.array([1 / names.count(n) for n in names])
    mean, middle = w @ k / w.sum(), w @ y / w.sum()
    p = k - mean
    alpha = np.linalg.solve(p.T @ (p * w[:, None]) + langid.RIDGE * among, p.T @ ((y - middle) * w[:, None]))
    asked = [*EN, *DE, "drei Hunde", "three dogs and a cat", "..", "é"]
    f = (np.array([[kernel(a, b) for b in marks] for a in asked]) - mean) @ alpha + middle
    lang, score = model.predict(asked)
    for text, row, name, s in zip(asked, f, lang, score, strict=True):
        if text == "..":
            assert name == langid.UNKNOWN and s == 0
        else:
            assert name == ("de", "en")[int(row.argmax())]
            assert abs(s - min(1, max(0, (row.max() + 1) / 2))) < 1e-3


def plain(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in w) for w in words]
    lines = [x for x in raw.split(b"\n") if x]
    pairs = list(zip(low, low[1:], strict=False))
    n, size = max(len(words), 1), max(len(raw), 1)
    count = lambda codes: sum(c in codes for c in raw)
    letters = sum(0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 for c in raw)
    return {
        "log_bytes": math.log1p(len(raw)),
        "log_words": math.log1p(len(words)),
        "letters": letters / size,
        "digits": count(b"0123456789") / size,
        "blanks": count(b" \t\n\v\f\r") / size,
        "marks": count(b".,;:!?'\"-()") / size,
        "signs": count(b"#$%&*+/<=>@[\\]^_`{|}~") / size,
        "capitals": sum(0x41 <= c <= 0x5A for c in raw) / max(letters, 1),
        "word_bytes": sum(map(len, words)) / n,
        "distinct": len(set(low)) / n,
        "adjacent": sum(a == b for a, b in pairs) / n,
        "commonest": max((low.count(x) for x in low), default=0) / n,
        "bigrams": (len(set(pairs)) / len(pairs) if pairs else 1.0) if words else 0.0,
        "line_repeats": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "line_words": len(words) / max(len(lines), 1),
        "ends_marked": sum(w[-1] in b".,;:!?#$%&*)" for w in words) / n,
        "bangs": raw.count(b"!") / n,
        "bars": sum(w == b"|" for w in words) / n,
        "links": raw.count(b"/") / n,
    }


TEXTS = ["", "one", "The the THE cat", "a | b | c\nhttp://x/y !! #5\n\n a | b | c\nend.", " \t\n", "é é É ß, 12,5 % (ok)", "same line\nsame line\nsame line", "z" * 5000, "w. " * 3000, "\x0bfold\x0cme\rplease"]


def test_statistics():
    raw = [t.encode() for t in TEXTS]
    got = quality.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, row in zip(TEXTS, got, strict=True):
        want = plain(text)
        assert list(want) == list(quality.STATISTICS)
        assert np.allclose(row, list(want.values()), atol=1e-9), text[:30]


def test_statistics_of_a_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (2, "tied id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_bytes string")
    got = sorted((tuple(r)[1:] for r in quality.statistics(docs).collect()))
    want = sorted(tuple(plain(t or "").values()) for _, t, _ in rows)
    assert np.allclose(got, want, atol=1e-9)
