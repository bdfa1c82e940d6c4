"""Plain Python versions that the operators are held against."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def span_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def documents(spark, columns=("doc_id", "text")):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*columns)


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    long = "the quick brown fox jumps over the lazy dog. " * 3000
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, long), (5, long), (6, long), (None, "a b c d e f"),
            (None, "a b c d e f"), (7, "ünï cödé 😀 wörds " * 20), (8, "a b c d e f"), (8, "other text here")]
    return spark.createDataFrame([(i, t, "src", "en", "x", True, 3.5, "k", [1]) for i, t in rows],
                                 "doc_id long, text string, source string, lang string, kept string, n_words boolean, "
                                 "spans double, __text string, secrets array<int>")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def components(sets, percent):
    """Smallest id reachable over links, by comparing all pairs that share a shingle."""
    at = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    shared = collections.Counter((a, b) for v in at.values() for k, a in enumerate(v) for b in v[k + 1:])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def secrets(text):
    out = []
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for rank, (kind, pattern, ok) in enumerate([("assign", assign, lambda m: len(m[1]) >= 6),
                                                ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
                                                ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def quality(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))
