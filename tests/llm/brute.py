"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCAN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _lowest(rows, sets):
    low = {}
    for i, r in enumerate(rows):
        if r is not None:
            low[sets.find(i)] = min(low.get(sets.find(i), r), r)
    return [low.get(sets.find(i)) for i in range(len(rows))]


def near_duplicates(rows, k, percent=80):
    """[(id, text)] → [(id, set size, component id)], in order."""
    shingles = []
    for _, t in rows:
        w = WORD.findall(fold(t))
        shingles.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    s = Sets(len(rows))
    for i, a in enumerate(shingles):
        for j in range(i):
            b = shingles[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    s.join(i, j)
    low = _lowest([i for i, _ in rows], s)
    return [(i, len(a), c) for (i, _), a, c in zip(rows, shingles, low)]


def remove_repeats(rows, length=50):
    """[(id, text)] → [(id, n_bytes, n_removed, n_spans, kept bytes)], in order."""
    raw = [((1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted(raw, key=lambda r: r[0]):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p:p + length], i)
    out = []
    for (i, b), (own, _) in zip(raw, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((own, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def scan(t, phrases):
    w, places, labels = SCAN.findall(fold(t)), [], set()
    for phrase, label in phrases:
        p = phrase.split(" ")
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def targets(sizes, weights=(1, 2, 3), cap=3):
    """{source: size} → {source: target}."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, stopped = sum(sizes.values()), set()
    while True:
        rest, free = whole - sum(cap * sizes[s] for s in stopped), [s for s in names if s not in stopped]
        out = {s: cap * sizes[s] if s in stopped else rest * w[s] / sum(w[x] for x in free) for s in names}
        above = {s for s in free if out[s] > cap * sizes[s]}
        if not above:
            return out
        stopped |= above


def embedding_links(rows, threshold=0.93):
    """[(id, vector, label)] → [(id, links, component id)], in order."""
    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    v = [np.array(r[1], float) if usable(r) else None for r in rows]
    s, links = Sets(len(rows)), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) \
                    and v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                s.join(i, j)
    return [(r[0], n, c) for r, n, c in zip(rows, links, _lowest([r[0] for r in rows], s))]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def hard_negatives(rows, is_anchor, scale=256, positives=5, negatives=3, low=50, high=95):
    """[(id, vector, label)] → sorted [(anchor id, positive id, rank, negative id, positive score, negative score)]."""
    use = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows
           if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q, lab) in enumerate(use):
        if i is None or not is_anchor(i):
            continue
        score = sorted((-sum(x * y for x, y in zip(q, r)), j is None, j or 0, m) for m, (j, r, _) in enumerate(use)
                       if m != n and len(r) == len(q))
        near = [(use[m][0], -s) for s, _, _, m in score if use[m][2] == lab][:positives]
        for p, ps in near:
            fit = [(use[m][0], -s) for s, _, _, m in score if use[m][2] != lab and low * ps <= -100 * s <= high * ps]
            out += [(i, p, k + 1, c, ps, ns) for k, (c, ns) in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def plant(doc_id, words):
    """The words of a document as the contract of the runs alters them; no id: unaltered."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def word_runs(w, min_length=6, min_exponent=4):
    """[(start, length, period)] by comparing the words with themselves, period by period."""
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(min_length, min_exponent * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def without_repeats(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _pii_valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(t):
    """[(kind, start, end)] of a text, as the contract has them."""
    return [(k, m.start(), m.end()) for k, rx in PII.items() for m in re.finditer(rx, t or "") if _pii_valid(k, m.group())]


def personal_data(rows, reach=80, generalise=0.75, remove=0.95):
    """[(id, text)] → [(id, spans with actions, clean text)], in order."""
    near, row_words, entities = [], [], []
    for _, t in rows:
        t = t or ""
        row_words.append(set(re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t))))
        own, seen = [], set()
        for k, rx in PII.items():
            every = [(m.start(), m.end()) for m in re.finditer(rx, t)]
            for n, (s, e) in enumerate(every):
                if not _pii_valid(k, t[s:e]):
                    continue
                entity = (k, re.sub("[^0-9]", "", t[s:e]) if k in ("card", "phone") else fold(t[s:e]))
                seen.add(entity)
                lo = max(every[n - 1][1] if n else 0, s - reach)
                hi = min(every[n + 1][0] if n + 1 < len(every) else len(t), e + reach)
                context = (fold(t[lo:s]), fold(t[e:hi]), lo == (every[n - 1][1] if n else 0), hi == (every[n + 1][0] if n + 1 < len(every) else len(t)))
                for a, b, whole_left, whole_right in ((lo, s, context[2], False), (e, hi, False, context[3])):
                    for m in re.finditer(r"[^\x20\x09-\x0D]+", t[a:b]):
                        if (m.start() == 0 and not whole_left) or (m.end() == b - a and not whole_right):
                            continue  # cut, or touching the entity
                        w = re.fullmatch(r"([!-/:-@\[-`{-~]{0,4})([^\x00-\x40\x5B-\x60\x7B-\x7F]{3,})[!-/:-@\[-`{-~]{0,4}", m.group())
                        if w:
                            own.append((entity, fold(w[2]), context, a + m.start() + len(w[1]), a + m.start() + len(w[1]) + len(w[2])))
        near.append(own)
        entities.append(seen)
    n, n_e = len(rows), collections.Counter(e for s in entities for e in s)
    n_t = collections.Counter(w for s in row_words for w in s)
    n_et = collections.Counter(p for own in near for p in {(e, w) for e, w, *_ in own})
    contexts = collections.defaultdict(set)
    for own in near:
        for e, w, c, *_ in own:
            contexts[e, w].add(c)
    out = []
    for (i, t), own in zip(rows, near):
        best = {}
        for e, w, _, a, b in own:
            if len(contexts[e, w]) > 1 and n_e[e] < n:
                score = math.log2(n * n_et[e, w] / (n_e[e] * n_t[w])) / math.log2(n / n_e[e])
                best[a, b] = max(score, best.get((a, b), -9))
        terms = [("term", a, b, "remove" if s >= remove - 1e-12 else "generalise") for (a, b), s in sorted(best.items()) if s >= generalise - 1e-12]
        spans = [(*s, "mask") for s in base_spans(t)] + terms
        clean, end = "", 0
        for k, a, b, act in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
            if a >= end:
                put = f"<{k.upper()}>" if k != "term" else "" if act == "remove" else "<NAME>" if "A" <= t[a] <= "Z" else "<WORD>"
                clean += t[end:a] + put
            end = max(end, b)
        out.append((i, spans, clean + (t or "")[end:]))
    return out


def license_matches(text, rules):
    """(start, end, label, confidence) of the matches no other match suppresses, by comparing each with each."""
    joined = re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", text or "").strip(" ").lower()
    every = sorted((m.start(), -m.end(), tier, k, confidence, label) for k, (_, label, tier, confidence, rx) in enumerate(rules)
                   for m in re.finditer(rf"(?<![^ ])(?:{rx})(?![^ ])", joined))
    out = []
    for i, (start, back, tier, _, confidence, label) in enumerate(every):
        if not any(s <= start and b <= back and t <= tier and (j < i or (s, b, t) != (start, back, tier))
                   for j, (s, b, t, *_) in enumerate(every) if j != i):
            out.append((start, -back, label, confidence))
    return out
