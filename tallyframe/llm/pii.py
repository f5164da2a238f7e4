"""Personal data by rules and a semi-Markov conditional random field.

Rules find e-mail and IP addresses, card and phone numbers.  Around every
long number, "@" and spelled-out address, whole candidate segments are scored by
features of the entire span, and bounded dynamic programming chooses
boundaries and types together.  The field is trained on labelled windows:
texts with planted entities and the plain text around them.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
#: The fixed rules, written so that no digit or name run is scanned twice.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The longest segment in tokens.
LONGEST = 14
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\x20A-Za-z0-9]|\x20+")
#: Characters on each side of an anchor that belong to its window.
REACH = 24
#: Windows for training and passes over them.
SAMPLES, EPOCHS = 900, 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules' matches, leftmost and not overlapping within a kind."""
    out = []
    if "@" in t:
        last = 0
        for m in AT.finditer(t):
            s = m.start()
            while s > last and t[s - 1] in LOCAL:
                s -= 1
            if s < m.start():
                out.append((0, s, m.end()))
                last = m.end()
    if any(c in t for c in "0123456789"):
        out += [(1, *m.span()) for m in IP.finditer(t) if all(len(p) <= 3 or not p.lstrip("0")[3:] for p in m[0].split(".")) and all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
        out += [(2, *m.span()) for m in CARD.finditer(t) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits_of(m[0])) <= 15] if "+" in t else []
    return out


def shape(s: str) -> list[str]:
    """Features of one whole segment."""
    d = digits_of(s)
    runs = re.findall(r"[0-9]+", s)
    low = s.lower()
    out = [f"d{min(len(d), 20)}", f"r{min(len(runs), 6)}", f"first{kind_of(s[0])}", f"last{kind_of(s[-1])}"]
    out += [f"has{c}" for c in "@.+-() " if c in s]
    if d:
        out.append("share" + str(int(4 * len(d) / len(s))))
        if len(d) == len(re.sub(r"[\x20().+-]", "", s)):
            out.append("numeric")
        if 13 <= len(d) <= 19:
            out.append("luhn" if luhn(d) else "noluhn")
        out.append("runs" + "-".join(str(min(len(r), 9)) for r in runs[:6]))
        if len(runs) == 4 and re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s):
            out.append("quad" if all(int(r) <= 255 for r in runs) else "badquad")
    if re.fullmatch(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", low):
        out.append("address")
    if re.fullmatch(r"[a-z0-9._%+-]+\x20*[\[(]?\x20?at\x20?[\])]?\x20*[a-z0-9-]+(?:\x20*[\[(]?\x20?(?:dot|\.)\x20?[\])]?\x20*[a-z]{2,})+", low):
        out.append("spelled")
    return out


def kind_of(c: str) -> str:
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() else c if c in "@+(-. " else "x"


class Field:
    """Weights by (kind, feature); a segment outside every entity is one token of score 0."""

    def __init__(self):
        self.w: list[dict[str, float]] = [{} for _ in KINDS]

    def segments(self, text: str):
        """Tokens' bounds and, for each candidate (first, last token), its score for each kind."""
        bounds = [m.span() for m in TOKEN.finditer(text)]
        found = {}
        for i, (a, _) in enumerate(bounds):
            if text[a] not in LOCAL and text[a] != "(" or a and text[a - 1].isalnum() and text[a].isalnum():
                continue
            for j in range(i, min(len(bounds), i + LONGEST)):
                e = bounds[j][1]
                if not (text[e - 1].isalnum() or text[e - 1] == "_") or text[e : e + 1].isalnum():
                    continue
                seg = text[a:e]
                if not any(c.isdigit() or c == "@" for c in seg) and not re.search(r"\bat\b", seg, re.IGNORECASE):
                    continue
                n = len(digits_of(seg))
                if n < 7 and not re.search(r"@|\bat\b|(?:[0-9]\.){1}[0-9]", seg, re.IGNORECASE):
                    continue
                found[i, j] = ["bias", "before" + kind_of(text[a - 1] if a else "^"), "after" + kind_of(text[e] if e < len(text) else "$"), *shape(seg)]
        return bounds, found

    def score(self, k: int, features: list[str]) -> float:
        w = self.w[k]
        return sum(w.get(f, 0.0) for f in features)

    def posterior(self, text: str, gold: set[tuple[int, int, int]]):
        """Log partition and marginals of (kind, first, last) segments by forward-backward, and the gold's score."""
        bounds, found = self.segments(text)
        n = len(bounds)
        by_start: dict[int, list] = {}
        for (i, j), f in found.items():
            for k in range(len(KINDS)):
                by_start.setdefault(i, []).append((j, k, self.score(k, f), f))
        ahead = np.full(n + 1, -np.inf)
        ahead[0] = 0.0
        for i in range(n):
            ahead[i + 1] = np.logaddexp(ahead[i + 1], ahead[i])
            for j, _, s, _ in by_start.get(i, ()):
                ahead[j + 1] = np.logaddexp(ahead[j + 1], ahead[i] + s)
        back = np.full(n + 1, -np.inf)
        back[n] = 0.0
        for i in range(n - 1, -1, -1):
            back[i] = back[i + 1]
            for j, _, s, _ in by_start.get(i, ()):
                back[i] = np.logaddexp(back[i], s + back[j + 1])
        out = []
        for i, own in by_start.items():
            for j, k, s, f in own:
                is_gold = (k, bounds[i][0], bounds[j][1]) in gold
                out.append((k, f, float(np.exp(ahead[i] + s + back[j + 1] - ahead[n])), is_gold))
        return out

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """The best (kind, start, end) segmentation."""
        bounds, found = self.segments(text)
        n = len(bounds)
        by_end: dict[int, list] = {}
        for (i, j), f in found.items():
            k = max(range(len(KINDS)), key=lambda k: self.score(k, f))
            by_end.setdefault(j, []).append((i, k, self.score(k, f)))
        best, how = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(n):
            best[j + 1] = best[j]
            for i, k, s in by_end.get(j, ()):
                if best[i] + s > best[j + 1] + 1e-9:
                    best[j + 1], how[j + 1] = best[i] + s, (i, k)
        out, j = [], n
        while j > 0:
            if how[j] is None:
                j -= 1
            else:
                i, k = how[j]
                out.append((k, bounds[i][0], bounds[j - 1][1]))
                j = i
        return out[::-1]

    def fit(self, windows: list[tuple[str, set]], epochs: int = EPOCHS, rate: float = 0.5, l2: float = 1e-4) -> "Field":
        """Stochastic gradient ascent on the conditional likelihood (AdaGrad steps)."""
        total: list[dict[str, float]] = [{} for _ in KINDS]
        for _ in range(epochs):
            for text, gold in windows:
                for k, features, p, is_gold in self.posterior(text, gold):
                    g = is_gold - p
                    if abs(g) < 1e-4:
                        continue
                    for f in features:
                        step = g - l2 * self.w[k].get(f, 0.0)
                        total[k][f] = total[k].get(f, 1e-6) + step * step
                        self.w[k][f] = self.w[k].get(f, 0.0) + rate * step / total[k][f] ** 0.5
        return self


def labelled_windows(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, set]]:
    """Windows of words with planted entities (labelled) and look-alikes (not labelled)."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))

    def card():
        d = r.choice("3456") + num(r.choice([14, 14, 14, 15]))
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))])

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{r.randint(1, 99)} {a} {b} {c}"])

    make = {
        0: lambda: r.choice(["{a}.{b}@{c}.{d}", "{a}@{c}.{d}", "{a}{n}@{c}-{b}.{d}", "{a} at {c} dot {d}", "{a} [at] {c} [dot] {d}", "{a}(at){c}.{d}"]).format(a=word(), b=word(), c=word(), d=r.choice(["com", "org", "net", "de", "example"]), n=num(2)),
        1: lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        2: card,
        3: phone,
    }
    other = [lambda: num(r.randint(1, 6)), lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(1)}.{num(2)}", lambda: num(r.randint(7, 14)), lambda: f"{num(3)} {num(3)}", lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"@{word()}", lambda: f"at {word()}", lambda: f"{word()} at {word()}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"${num(3)},{num(3)}.{num(2)}", lambda: f"{word()}-{num(8)}", lambda: f"{num(8)}-{num(4)}-{num(4)}"]
    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(0, 3))), set()
        for _ in range(r.randint(1, 2)):
            text += r.choice(["", " ", ": ", ", ", "\n"]) if text else ""
            if text and text[-1].isalnum():
                text += " "
            if r.random() < 0.6:
                k = r.randrange(4)
                e = make[k]()
                gold.add((k, len(text), len(text) + len(e)))
            else:
                e = r.choice(other)()
            text += e + r.choice(["", ".", ",", " " + word(), ")", "\n" + word()])
        out.append((text, gold))
    return out


#: Only around these can a segment have a positive score.
NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}|@|[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]")
SPELLED = re.compile(r"[\[(]at[\])]|\x20at\x20[^\n]{0,40}?\x20dot\x20|\x20at\x20[^\n]{0,40}?[\[(]dot[\])]", re.IGNORECASE)
CHEAP = re.compile(r"[0-9@]")


def anchors(text: str):
    if CHEAP.search(text):
        yield from NUMBER.finditer(text)
    low = text.lower()
    if "dot" in low or "(at)" in low or "[at]" in low:
        yield from SPELLED.finditer(text)


def model_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    out = []
    for m in sorted(anchors(text), key=lambda m: m.start()):
        a, e = max(0, m.start() - 2 * REACH), min(len(text), m.end() + 2 * REACH)
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    found = []
    for a, e in out:
        # A very long window is decoded in overlapping steps, so that the work stays in proportion.
        for s in range(a, e, 400):
            x, y = max(a, s - 2 * REACH), min(e, s + 400 + 2 * REACH)
            found += [(k, x + p, x + q) for k, p, q in field.decode(text[x:y]) if s <= x + p < s + 400]
    return found


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for k, a, e in sorted(spans))


def apart(base: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans, in order of their start, that overlap neither ``base`` nor one kept before."""
    starts, ends = [], []
    for _, a, e in sorted(base, key=lambda x: x[1:]):
        if starts and a < ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(a)
            ends.append(e)
    out, last = [], 0
    for k, a, e in sorted(spans, key=lambda x: x[1]):
        i = bisect_left(starts, e) - 1
        if a >= last and (i < 0 or ends[i] <= a):
            out.append((k, a, e))
            last = e
    return out


def scanner(field: Field):
    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = apart(base, model_spans(text, field))
                rows.append((*(sum(x[0] == k for x in base) for k in range(4)), hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + more)))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of (doc_id, text).

    Counts and base_sha256 are of the rules' spans; spans also has those of
    the field that overlap none of them, all as kind:start:end in code points,
    end exclusive, by kind, then start.  ``field`` is a trained field (trained
    on its labelled windows when None).

    A null text counts as empty and has no spans; a null doc_id stays null;
    repeated rows stay repeated; other columns are ignored; an empty table
    gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or Field().fit(labelled_windows()))

    def run(batches):
        return scanner(held.value)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
