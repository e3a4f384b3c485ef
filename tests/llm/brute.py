"""Plain-Python versions of the registered results, one document or pair at a time."""

import hashlib
import re
import zlib
from collections import Counter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontamination(docs, items):
    """docs: (doc_id, text); items: (item_id, text)."""
    windows = {}
    for item_id, text in items:
        w = alnum(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[i : i + n]))) is not None:
                    found |= owners
                    hit.update(range(i, i + n))
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def substring_dedup(docs, window=50):
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def quality_base(doc_id, text):
    w = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            repeated.update((i, i + 1, i + 2))
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return (doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)


def secrets(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, "hex", m.end()))
    spans.sort()
    kinds = Counter(s[2] for s in spans)
    return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))


def crc(text):
    return zlib.crc32((text or "").encode())


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def secret_spans(text):
    """All spans: the base ones and those of five well-known token forms."""
    text = text or ""
    found = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    more = (
        ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0), ("github", "gh[pousr]_[A-Za-z0-9]+", 40), ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
        ("google", "AIza[A-Za-z0-9_-]+", 39), ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    )
    for place, (kind, pattern, least) in enumerate(more, 1):
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def common_words(text, template):
    """Length of the longest common subsequence of two word lists (one bit for each word of the template)."""
    w, t = alnum(text), alnum(template)
    masks = {}
    for i, x in enumerate(t):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(t)) - 1
    for x in w:
        u = row & masks.get(x, 0)
        row = (row + u | row - u) & full
    return len(t) - row.bit_count()


def holds(text, template):
    """Whether the template's words stand in the text one after the other."""
    return f" {' '.join(alnum(template))} " in f" {' '.join(alnum(text))} "


def posteriors(votes, rounds=200):
    """EM over documents one by one: ``votes`` are lists of 0 (drop), 1 (abstain), 2 (keep); the posterior of each document."""
    import math

    good = [(0.97, 0.6, 0.03)[min(v.count(0), 2)] for v in votes]
    share = 0.5
    for _ in range(rounds):
        mass = [1.0, 1.0]
        table = [[[1.0] * 3 for _ in range(2)] for _ in votes[0]]
        for v, p in zip(votes, good, strict=True):
            for c, w in ((0, 1 - p), (1, p)):
                mass[c] += w
                for i, d in enumerate(v):
                    table[i][c][d] += w
        new = mass[1] / sum(mass)
        rate = [[[x / sum(t[c]) for x in t[c]] for c in range(2)] for t in table]
        for k, v in enumerate(votes):
            odds = math.log(new / (1 - new)) + sum(math.log(rate[i][1][d] / rate[i][0][d]) for i, d in enumerate(v))
            good[k] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        if abs(new - share) < 1e-9:
            break
        share = new
    return good
