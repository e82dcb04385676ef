"""Plain Python versions of what the training-text queries return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def jaccard(rows):
    """Of (doc_id, text): {doc_id: (n_shingles, component_id)}."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    common = Counter()
    for held in holders.values():
        for x in range(len(held)):
            for y in range(x):
                common[held[y], held[x]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = set()
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            hit.update(range(k, k + 5))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def leaks(rows, items):
    """Of (doc_id, text) and (item_id, text): {doc_id: (n_words, n_hit, n_items, sha256)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in rows:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out


def repeats(rows):
    """Of (doc_id, text): {doc_id: (n_words, n_removed, kept sha256)}; 35-word windows."""
    words = [(i, WORD.findall(text or "")) for i, text in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    out = {}
    for i, w in words:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    """Base spans (start, order of kind, end) of a text."""
    out = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def pii_row(text):
    spans, kinds = pii(text), list(PII)
    counts = Counter(order for _, order, _ in spans)
    return (*(counts[k] for k in range(4)), sha(",".join(f"{kinds[o]}:{s}:{e}" for s, o, e in spans)))


def crc_ids(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
