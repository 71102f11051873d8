"""Small tables with every awkward case, and brute-force counterparts of the operators."""

import hashlib
import re
from fractions import Fraction
from collections import Counter

LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    base = " ".join(f"word{i} the of Zürich" for i in range(40))
    near = base.replace("word7 ", "other7 ")
    passage = " ".join(f"passage{i}" for i in range(70))
    return [
        (1, base, "en", "a", len(base)), (2, near, "en", "a", None), (3, base.upper().replace("Ü", "ü"), None, "b", 1),
        (3, base.upper().replace("Ü", "ü"), None, "b", 1), (4, None, "en", None, None), (5, "", "de", "", 0), (6, " \t\n ", None, "c", 4),
        (7, "one two", "fr", "c", 7), (8, "One  TWO", "fr", None, 8), (None, base, None, None, None), (None, "only null id here", "en", "z", 3),
        (9, passage + "\nsome own line with more than eight words in it\n" + passage, "en", "a", 5),
        (10, "intro words first\n" + passage + "\nend of it", "de", "b", 6), (11, "x" * 30000, None, "b", 30000),
        (12, "ab " * 9000, "en", "b", 1), (13, "mail a.b@c.de or +1 (234) 555-1234, 4111 1111 1111 1111 10.0.0.1 300.1.1.1", "de", "b", 2),
        (14, "!!! ### 123 <|endoftext|> 🙂🙂 漢字", "es", "é", 9), (15, "IBAN DE89 3704 0044 0532 0130 00 and ssn 123-45-6789", "es", "é", 9)]


def documents(spark, clash=False):
    df = spark.createDataFrame(rows(), SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        for name in ("pii", "language", "tokens", "mix", "size", "score", "spans", "rid", "key", "place", "quota", "in", "start"):
            df = df.withColumn(name, F.lit("kept"))
    return df


def blank_words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text):
    w = blank_words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(docs):
    """(doc_id, n, component) of (doc_id, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(docs):
        ids = [d for k, (d, _) in enumerate(docs) if find(k) == find(i) and d is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return out


def repeats(docs, length):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(docs, data):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)}


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m.group())]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def contaminated(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = item_words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in windows[tuple(w[i:i + size])] if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def quality_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def targets(sizes, weights, share, most):
    """Shares by weight of ``share`` times all sizes; what passes ``most`` times its size stops there, the excess is
    shared again among the others by weight. In fractions, source by source."""
    out = {}
    total = share * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in out]
        left, weight = total - sum(out.values()), sum(weights[i] for i in free)
        given = {i: left * weights[i] / weight for i in free}
        over = [i for i in free if given[i] > most * sizes[i]]
        if not over:
            out |= given
            return [Fraction(out[i]) for i in range(len(sizes))]
        out |= {i: Fraction(most * sizes[i]) for i in over}
