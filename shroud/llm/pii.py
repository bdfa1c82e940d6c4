"""Personal data: base patterns, then a character-level BiLSTM-CRF.

The tagger is trained in numpy from labelled spans: windows of a bounded sample
of documents, labelled by the base patterns, and spans in forms that the patterns
do not match (other separators, missing plus signs, spelled-out signs) set
between parts of the same documents. Texts are cut into overlapping windows;
each window is decoded on its own, and the spans of all windows of a text are
reconciled together. Spans that reach over a window's edges are joined to runs
and decoded again, a run in one window with room on either side, up to
``WIDEST`` characters: the work stays in proportion to the text, and a tagger's
span of up to half that length is found whole. Windows without a digit, an at
sign or a spelled-out one before a name and a dot hold no span by definition
(every span has one of them) and are not scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_budget, ship_package, smallest_hashes, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
WINDOW, STRIDE = 96, 32

# Fixed values of the contract. Where a match could begin in the middle of a run, the look-behind only
# spares the search the run's other places: the first one matches whenever they do.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# a spelled-out at sign with a name and a dot, or a spelled-out one, behind it
_AT = re.compile(r"(?:(?<![A-Za-z])[Aa][Tt](?![A-Za-z])|(?<=[a-z0-9])AT(?=[a-z]))(?=[\])}>]?\x20{0,2}(?:[a-z0-9-]{1,64}DOT[a-z]|[A-Za-z0-9-]{1,4096}+"
                 r"(?:\.[A-Za-z]|\x20{0,2}[\[({<]?\x20?(?:[Dd][Oo][Tt](?![a-z])|\.)[\])}>]?\x20?[A-Za-z])))")
#: Width at which widening ends: the tagger's spans of up to half of it are found whole.
WIDEST = 8192
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The contract's matches, by start, then kind as listed."""
    out: list[tuple[int, int, str, int]] = []
    if "@" in text:
        end, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            m = _DOMAIN.match(text, at) if start < at else None
            if m:
                end = m.end()
                out.append((start, 0, "email", end))
            at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


# --------------------------------------------------------------- characters
def _alphabet():
    """Code point -> input id: a-z one by one, A-Z as one, digits one by one,
    each sign of personal data, line ends, other signs, other letters."""
    import numpy as np

    table = np.full(0x110000, 0, np.uint8)
    table[128:] = 1  # letters and signs beyond ASCII
    table[33:127] = 2  # other signs
    table[65:91] = 3
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789@._%+-()[] \n"):
        table[ord(c)] = 4 + i
    return table


_TABLE: list = []
VOCABULARY = 4 + 26 + 10 + 12
PAD = 0


def encode(text: str):
    import numpy as np

    if not _TABLE:
        _TABLE.append(_alphabet())
    return _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


# -------------------------------------------------------------------- model
def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-x))


def _allowed():
    """0 where a label may follow another, a large negative number where not."""
    import numpy as np

    a = np.zeros((len(LABELS), len(LABELS)), np.float32)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, of in enumerate(LABELS):
                if of[2:] != to[2:]:
                    a[i, j] = -1e4
    return a


def init(hidden: int, seed: int) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)

    def g(*shape):
        return (rng.standard_normal(shape) * 0.2).astype(np.float32)

    p = {}
    for d in "fb":
        p |= {f"x{d}": g(VOCABULARY, 4 * hidden), f"h{d}": g(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
        p[f"c{d}"][hidden:2 * hidden] = 1  # open forget gates
    return p | {"o": g(2 * hidden, len(LABELS)), "ob": np.zeros(len(LABELS), np.float32), "a": np.zeros((len(LABELS),) * 2, np.float32)}


def _lstm(p: dict, d: str, ids, keep: bool):
    """States (time, rows, hidden) of one direction; with what its gradient needs."""
    import numpy as np

    steps, rows = ids.shape
    hidden = p[f"h{d}"].shape[0]
    order = range(steps) if d == "f" else range(steps - 1, -1, -1)
    table, recurrent = p[f"x{d}"] + p[f"c{d}"], p[f"h{d}"]
    h = c = np.zeros((rows, hidden), table.dtype)
    out, memo = np.empty((steps, rows, hidden), table.dtype), []
    for t in order:
        z = table[ids[t]]
        z += h @ recurrent
        gates = _sigmoid(z[:, :3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
        g = np.tanh(z[:, 3 * hidden:])
        before, was = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            memo.append((t, i, f, o, g, before, tc, was))
    return out, memo


def emissions(p: dict, ids, keep: bool = False):
    """Scores (time, rows, labels) of windows given as ids (time, rows)."""
    import numpy as np

    f, mf = _lstm(p, "f", ids, keep)
    b, mb = _lstm(p, "b", ids, keep)
    hs = np.concatenate([f, b], axis=2)
    return hs @ p["o"] + p["ob"], hs, mf, mb


def gradients(p: dict, ids, gold) -> tuple[float, dict]:
    """Mean negative log-likelihood of the CRF and its gradient. The sums over
    label paths run over probabilities that are scaled to 1 in each step."""
    import numpy as np

    steps, rows = ids.shape
    n = len(LABELS)
    e, hs, mf, mb = emissions(p, ids, True)
    a = np.exp(p["a"] + _allowed())
    top = e.max(2, keepdims=True)
    odds = np.exp(e - top)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty_like(top)
    now = odds[0] * np.exp(_FIRST())
    for t in range(steps):
        if t:
            now = (alpha[t - 1] @ a) * odds[t]
        scale[t] = now.sum(1, keepdims=True)
        alpha[t] = now / scale[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = ((odds[t + 1] * beta[t + 1]) @ a.T) / scale[t + 1]
    z = (np.log(scale) + top).sum()
    loss = float(z - np.take_along_axis(e, gold[:, :, None], 2).sum() - p["a"][gold[:-1], gold[1:]].sum())
    da = a * (alpha[:-1].reshape(-1, n).T @ (odds[1:] * beta[1:] / scale[1:]).reshape(-1, n))
    np.subtract.at(da, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    de = alpha * beta
    np.subtract.at(de, (np.arange(steps)[:, None], np.arange(rows)[None, :], gold), 1)
    de /= rows
    hidden = p["hf"].shape[0]
    g = {"a": da / rows, "o": hs.reshape(-1, 2 * hidden).T @ de.reshape(-1, n), "ob": de.sum((0, 1))}
    dh = de @ p["o"].T
    symbols = (ids.reshape(-1)[None] == np.arange(VOCABULARY)[:, None]).astype(e.dtype)
    for d, memo, part in (("f", mf, dh[:, :, :hidden]), ("b", mb, dh[:, :, hidden:])):
        dn = dc = np.zeros((rows, hidden), e.dtype)
        back, states = np.empty((steps, rows, 4 * hidden), e.dtype), np.empty((steps, rows, hidden), e.dtype)
        for t, i, f, o, c_in, before, tc, was in reversed(memo):
            dt = part[t] + dn
            dc = dc + dt * o * (1 - tc * tc)
            dz = back[t]
            dz[:, :hidden], dz[:, hidden:2 * hidden] = dc * c_in * i * (1 - i), dc * before * f * (1 - f)
            dz[:, 2 * hidden:3 * hidden], dz[:, 3 * hidden:] = dt * tc * o * (1 - o), dc * i * (1 - c_in * c_in)
            dc = dc * f
            dn = dz @ p[f"h{d}"].T
            states[t] = was
        flat = back.reshape(-1, 4 * hidden)
        g |= {f"x{d}": symbols @ flat, f"h{d}": states.reshape(-1, hidden).T @ flat, f"c{d}": flat.sum(0)}
    return loss / rows, g


def _FIRST():
    """A window does not begin inside a span."""
    import numpy as np

    return np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], np.float32)


def decode(p: dict, ids) -> list[list[tuple[str, int, int, float]]]:
    """Viterbi spans of each window (column of ``ids``): kind, start, end, score
    (the log-odds of the labels on it, with the steps into and out of it,
    against O all along)."""
    import numpy as np

    e = emissions(p, ids)[0]
    steps, rows = ids.shape
    a = p["a"] + _allowed()
    score, back = e[0] + _FIRST(), np.zeros((steps, rows, len(LABELS)), np.int8)
    for t in range(1, steps):
        s = score[:, :, None] + a[None]
        back[t] = s.argmax(1)
        score = s.max(1) + e[t]
    path = np.empty((steps, rows), np.int8)
    path[-1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = np.take_along_axis(back[t], path[t][:, None].astype(int), 1)[:, 0]
    gain = np.take_along_axis(e, path[:, :, None].astype(int), 2)[:, :, 0] - e[:, :, 0]
    move = a[path[:-1], path[1:]] - a[0, 0]  # into each place but the first
    gain[1:] += np.where(path[1:] > 0, move, 0)
    gain[:-1] += np.where((path[:-1] > 0) & (path[1:] == 0), move, 0)
    out = []
    for r in range(rows):
        spans: list[tuple[str, int, int, float]] = []
        labels = path[:, r]
        t = 0
        hot = np.flatnonzero(labels)
        while len(hot):
            t = int(hot[0])
            kind, end = LABELS[labels[t]][2:], t + 1
            while end < steps and labels[end] and LABELS[labels[end]] == f"I-{kind}":
                end += 1
            spans.append((kind, t, end, float(gain[t:end, r].sum())))
            hot = hot[hot >= end]
        out.append(spans)
    return out


# ----------------------------------------------------------------- training


#: Forms of spans to learn; the first of each kind is the one that the base patterns match.
FORMS = (("email", "{l}@{h}.{e}"), ("email", "{l} [at] {h} [dot] {e}"), ("email", "{l} (at) {h}.{e}"), ("email", "{l} @ {h}.{e}"), ("email", "{l}[at]{h}.{e}"),
         ("email", "{l} AT {h} DOT {e}"), ("email", "{l} at {h} dot {e}"), ("email", "{l} (at) {h} (dot) {e}"),
         ("ip", "{0}.{1}.{2}.{3}"), ("ip", "{0} . {1} . {2} . {3}"), ("ip", "{0}[.]{1}[.]{2}[.]{3}"), ("ip", "{0}. {1}. {2}. {3}"),
         ("card", "{c0}{s}{c1}{s}{c2}{s}{c3}"), ("card", "{c0}.{c1}.{c2}.{c3}"), ("card", "{c0} - {c1} - {c2} - {c3}"),
         ("phone", "+1 ({x}) {y}-{z}"), ("phone", "({x}) {y}-{z}"), ("phone", "{x}-{y}-{z}"), ("phone", "{x}.{y}.{z}"), ("phone", "+{cc} {x} {y} {z}"))
_PLAIN = ("{d4}", "{d1},{d3}", "{d2}:{d2}", "{d1}.{d2}", "v{d1}.{d1}.{d2}", "20{d2}-0{d1}-1{d1}", "{d6}ab{d6}cdef", "AKIA{d8}QWER", "at", "(at)", "{d3}", "{d8}", "{d12}", "{d20}",
          "{d1}.{d1}.{d1}", "{w} at the {w}. {w}", "{w} @ {w}", "{w}@", "@{w}", "{d3} {d3}", "{d2}-{d2}", "+{d2}", "{d5}.{d2}", "at {d2}:{d2}", "{w}.{w}", "dot {w}", "[{d1}]", "({d3})", "{d16}")


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _variant(rng, form: str, words: list[str]) -> str:
    """A span of ``form`` with new digits and, as names, letters or words."""
    def name(n: int) -> str:
        if words and rng.random() < 0.5:
            return words[int(rng.integers(0, len(words)))]
        return "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    local = name(int(rng.integers(3, 10)))
    if rng.random() < 0.4:
        local += ["." + _digits(rng, 2), "." + name(5), "_" + name(4), _digits(rng, 1), _digits(rng, 2)][int(rng.integers(0, 5))]
    host = name(int(rng.integers(3, 10))) + (["." + name(5), "-" + name(4), _digits(rng, 1)][int(rng.integers(0, 3))] if rng.random() < 0.3 else "")
    card = "4" + _digits(rng, 14)
    card += next(c for c in "0123456789" if luhn(card + c))
    return form.format(*map(int, rng.integers(0, 256, 4)), l=local, h=host, e=["com", "org", "net", "de", "fr", "example", "io"][int(rng.integers(0, 7))],
                       s=["", " ", "-"][int(rng.integers(0, 3))], c0=card[:4], c1=card[4:8], c2=card[8:12], c3=card[12:],
                       x=_digits(rng, 3), y=_digits(rng, 3), z=_digits(rng, 4), cc=_digits(rng, 2))


def _plain(rng, words: list[str]) -> str:
    """Numbers and signs that are nobody's."""
    form = _PLAIN[int(rng.integers(0, len(_PLAIN)))]
    out = re.sub(r"\{d([0-9]+)\}", lambda m: _digits(rng, int(m[1])), form)
    return re.sub(r"\{w\}", lambda m: words[int(rng.integers(0, len(words)))] if words else "x", out)


def training_windows(texts: list[str], seed: int = 7, size: int = 72, most: int = 8_000):
    """(ids, labels), each (time, windows), up to ``most``: in turn a window
    with a span of each of FORMS between parts of a text without spans, one
    around base spans as they stand, and two without any, with other numbers
    and signs in half of them."""
    import numpy as np

    rng = np.random.default_rng(seed)
    xs, ys = [], []
    spans = {k: base_spans(t) for k, t in enumerate(texts)}
    some = [k for k, v in spans.items() if v]
    words = sorted({w for t in texts[:300] for w in re.findall(r"\b[a-z]{3,10}\b", t)})

    def add(text: str, found: list[Span]) -> None:
        ids, y = np.full(size, PAD, np.uint8), np.zeros(size, np.int64)
        e = encode(text[:size])
        ids[:len(e)] = e
        for kind, s, t in found:
            if t <= size:
                y[s] = LABELS.index(f"B-{kind}")
                y[s + 1:t] = LABELS.index(f"I-{kind}")
            elif s < size:
                ids[s:] = PAD
        xs.append(ids)
        ys.append(y)

    def piece(n: int) -> str:
        """``n`` characters of some text, without a span and, mostly, from a word's start."""
        for _ in range(4):
            k = int(rng.integers(0, len(texts)))
            at = int(rng.integers(0, max(1, len(texts[k]) - n)))
            if not any(s < at + n and e > at for _, s, e in spans[k]):
                return texts[k][at:at + n]
        return ""

    while texts and len(xs) < most:
        for kind, form in FORMS:
            value = _variant(rng, form, words)
            left, right = piece(int(rng.integers(0, size - 20))), piece(size)
            left = left[:max(0, size - len(value) - int(rng.integers(0, 8)))]
            # beside a span stands what is no part of one
            left = re.sub(r"[^\s(\"'=:,;<>]*$", "", left) if rng.random() < 0.9 else re.sub(r"[A-Za-z0-9@._%+-]*$", "", left)
            right = [" ", " ", ", ", ". ", "\n", ") ", "; "][int(rng.integers(0, 7))] + right.lstrip()
            left, right = left if rng.random() < 0.9 else "", right if rng.random() < 0.85 else ""  # a text's start or end
            left = left if rng.random() < 0.8 else left.rsplit("\n", 1)[-1][-int(rng.integers(4, 24)):]
            if not base_spans(left) and not base_spans(right):
                add(left + value + right, [(kind, len(left), len(left) + len(value))])
        if some:
            for _ in range(5):
                k = some[int(rng.integers(0, len(some)))]
                _, s, t = spans[k][int(rng.integers(0, len(spans[k])))]
                at = max(0, s - int(rng.integers(0, max(1, size - (t - s)))))
                inside = [(x, a - at, b - at) for x, a, b in spans[k] if a >= at and b <= at + size]
                clash = any(a < d and c < b for i, (_, a, b) in enumerate(inside) for _, c, d in inside[i + 1:])
                if not clash and not any(a < at < b or a < at + size < b for _, a, b in spans[k]):
                    add(texts[k][at:at + size], inside)
        for _ in range(len(FORMS)):
            part = piece(size)
            if rng.random() < 0.7:
                where = int(rng.integers(0, len(part) + 1))
                part = (part[:where] + " " + _plain(rng, words) + " " + part[where:])[:size]
            if not base_spans(part):
                add(part, [])
    if not xs:
        add("", [])
    return np.stack(xs[:most], 1), np.stack(ys[:most], 1)


def fit(ids, gold, *, hidden: int = 24, steps: int = 1600, rows: int = 64, rate: float = 0.015, seed: int = 3) -> dict:
    """Train by Adam on batches of windows; the same input, the same model."""
    import numpy as np

    rng = np.random.default_rng(seed)
    p = init(hidden, seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, ids.shape[1], rows)
        _, g = gradients(p, ids[:, pick], gold[:, pick])
        lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for k in p:
            grad = np.clip(g[k], -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return p


def sample_texts(docs: DataFrame, *, id_col: str, text_col: str, limit: int, characters: int) -> list[str]:
    """An excerpt of ``characters`` of each of the at most ``limit`` documents
    with the smallest hashes of their ids (broadcast, few by that bound): around
    the first at sign, plus sign or digit of every other one, from a place that
    the id's hash chooses in the rest."""
    ids = smallest_hashes(docs.select(F.col(id_col).alias("id")).where("id is not null").distinct(), limit)
    t, h = text_or_empty(text_col), F.xxhash64("id", F.lit("place"))
    first = F.regexp_instr(t, F.lit("[0-9@+]"))
    around = F.greatest(first - characters // 2, F.lit(1))
    anywhere = (F.pmod(h, F.greatest(F.length(t) - characters, F.lit(1))) + 1).cast("int")
    part = F.substr(t, F.when((first > 0) & (F.pmod(F.xxhash64(h), F.lit(2)) == 0), around).otherwise(anywhere), F.lit(characters))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col)).join(F.broadcast(ids), "id")
            .select("id", part.alias("part")).where("part <> ''").groupBy("id").agg(F.min("part").alias("part")).collect())
    return [r["part"] for r in sorted(rows, key=lambda r: (str(r["id"]), r["part"]))][:limit]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 3_000, characters: int = 600,
          **how) -> dict:
    """The tagger, from the excerpts of at most ``limit`` documents of ``characters`` of ``docs``
    each (the documented bound of the sample). Without any it is trained on empty
    windows and finds nothing."""
    return fit(*training_windows(sample_texts(docs, id_col=id_col, text_col=text_col, limit=limit, characters=characters)), **how)


# ---------------------------------------------------------------- detection
def _plausible(kind: str, value: str) -> bool:
    digits = _NOT_DIGIT.sub("", value)
    if kind == "email":
        return ("@" in value or "at" in value.lower()) and len(value) >= 6 and ("." in value or "dot" in value.lower())
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def _may_grow(kind: str, value: str) -> bool:
    """Whether a longer span around ``value`` can be plausible."""
    if kind == "ip":
        return len(re.findall("[0-9]+", value)) <= 4
    return kind == "email" or len(_NOT_DIGIT.sub("", value)) <= (19 if kind == "card" else 15)


def reconcile(found: list[tuple[str, int, int, float]]) -> list[Span]:
    """The set of non-overlapping spans with the largest sum of scores, over the
    spans of all windows of a text."""
    import bisect

    best: dict[Span, float] = {}
    for k, s, e, score in found:
        if score > 0:
            best[k, s, e] = max(best.get((k, s, e), 0.0), score)
    spans = sorted(best, key=lambda x: (x[2], x[1], x[0]))
    ends = [x[2] for x in spans]
    total, take = [0.0], []
    for i, (k, s, e) in enumerate(spans):
        j = bisect.bisect_right(ends, s, 0, i)
        take.append((total[j] + best[k, s, e] > total[i], j))
        total.append(max(total[i], total[j] + best[k, s, e]))
    out, i = [], len(spans)
    while i:
        yes, j = take[i - 1]
        if yes:
            out.append(spans[i - 1])
        i = j if yes else i - 1
    return out[::-1]


def _runs(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(text, start, end) with those that overlap or touch joined."""
    out: list[tuple[int, int, int]] = []
    for d, s, e in sorted(spans):
        if out and out[-1][0] == d and s <= out[-1][2]:
            out[-1] = (d, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((d, s, e))
    return out


def _batches(windows: list[tuple[int, int, int]], cells: int) -> Iterator[list]:
    """Windows (text, start, width) of like width, up to ``cells`` characters together."""
    part: list = []
    for w in sorted(windows, key=lambda x: (x[2], x)):
        if part and (w[2] > 1.5 * part[0][2] or (len(part) + 1) * w[2] > cells):
            yield part
            part = []
        part.append(w)
    if part:
        yield part


def find_spans(p: dict, texts: list[str], *, rows: int = 2048, min_score: float = 0.5) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text, by start, then kind: the base ones (True), and
    the tagger's that overlap none of them."""
    import numpy as np

    code = [encode(t) for t in texts]
    places: list[tuple[int, int]] = []
    for d, c in enumerate(code):
        signs = np.array([m.start() for m in _AT.finditer(texts[d])], int)
        hits = np.union1d(np.flatnonzero((c >= 30) & (c <= 40)), signs)  # digits, the at sign, spelled-out ones
        if len(hits):
            k = np.unique(np.concatenate([hits // STRIDE - j for j in range(WINDOW // STRIDE)]))
            places += [(d, int(x) * STRIDE) for x in k if x >= 0]
            if hits[0] < WINDOW and (k < 0).any() and (not len(places) or places[-1][0] != d):
                places.append((d, 0))
    found: dict[int, list] = {}
    margin, windows = WINDOW, [(d, at, WINDOW) for d, at in places]
    while windows:
        cut: list[tuple[int, int, int]] = []
        for part in _batches(windows, rows * WINDOW):
            width = max(w for _, _, w in part)
            ids = np.full((width, len(part)), PAD, np.uint8)
            for r, (d, at, w) in enumerate(part):
                piece = code[d][at:at + w]
                ids[:len(piece), r] = piece
            for (d, at, w), spans in zip(part, decode(p, ids), strict=True):
                n = len(code[d])
                for kind, s, e, score in spans:
                    # a span at a window's inner edge is another window's, or too long for this one
                    if (s == 0 and at > 0) or (e >= w and at + w < n):
                        if e - s >= WINDOW // 2 and _may_grow(kind, texts[d][at + s:at + min(e, w)]):
                            cut.append((d, at + s, at + min(e, w)))
                    elif at + e <= n and score >= min_score:
                        found.setdefault(d, []).append((kind, at + s, at + e, score))
        # spans that touch are one run, decoded whole with a margin on either side; wider in each round
        windows = []
        for d, s, e in _runs(cut):
            at, end = max(0, s - margin), min(len(code[d]), e + margin)
            if end - at <= WIDEST:
                windows.append((d, at, end - at))
            elif margin < WIDEST:  # too long for one span: windows that overlap by half, for those inside it
                windows += [(d, x, min(WIDEST, end - x)) for x in range(at, max(at + 1, end - WIDEST // 2), WIDEST // 2)]
        margin = WIDEST if any(w == WIDEST for _, _, w in windows) else margin * 4
        if margin > 4 * WIDEST:
            break
    out = []
    for d, text in enumerate(texts):
        base = base_spans(text)
        spans = [(k, s, e, True) for k, s, e in base]
        if d in found:
            more = [x for x in found[d] if not any(s < x[2] and x[1] < e for _, s, e in base) and _plausible(x[0], text[x[1]:x[2]])]
            spans += [(k, s, e, False) for k, s, e in reconcile(more)]
        out.append(sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), not x[3], x[2])))
    return out


def _finder(model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        p = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in row_budget(zip(batch.column(0).to_pylist(), texts, strict=True), map(len, texts), 2 << 20):
                spans = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in find_spans(p, [t for _, t in part])]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], batch.column(0).type), pa.array(spans, spans_type)],
                                                 names=["doc_id", "spans"])

    return run


def find_pii(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: array of struct(kind, start, end, base) of every whole
    text, by start, then kind; code points, end exclusive.

    Base spans always stay; the tagger's are added where they overlap none.
    Defined cases: a null or empty text has no spans; a very long text is
    searched whole, in time that grows with its length; rows that repeat are
    searched alike; of spans that overlap the set with the best scores stays; an
    empty table gives no rows; other columns are not read. The model (some 50 KB)
    is broadcast."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_finder(shared), f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, base spans counted by kind and hashed, all spans as text."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["base"])
    def count(kind):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
