"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re

SPACES = "[^\\x20\\x09-\\x0D]+"
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def spaced_words(text, lower=False):
    return re.findall(SPACES, (text or "").translate(UPPER) if lower else (text or ""))


def contamination(text, items, window=10):
    """(words, hit words, item ids) of one text."""
    words = alnum_words(text)
    hit, found = set(), set()
    for name, item in items:
        own = alnum_words(item)
        size = min(window, len(own))
        for j in range(len(own) - size + 1 if own else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[j : j + size]:
                    hit |= set(range(i, i + size))
                    if name is not None:
                        found.add(str(name))
    return len(words), len(hit), sorted(found)


def shingles(text, size=5):
    words = spaced_words(text, lower=True)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def classes(docs):
    """{key: (set size, smallest key reached)} of (key, text) rows."""
    sets = {k: shingles(t) for k, t in docs}
    lead = {k: k for k in sets}

    def top(k):
        while lead[k] != k:
            k = lead[k]
        return k

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((top(a), top(b)))
                lead[q] = p
    return {k: (len(sets[k]), top(k)) for k in keys}


def without_repeats(docs, window=50):
    """[(key, words, removed words, kept text)] of (key, text) rows."""
    least = {}
    split = [(k, spaced_words(t)) for k, t in docs]
    for k, w in split:
        for i in range(len(w) - window + 1):
            if k is not None:
                run = tuple(w[i : i + window])
                least[run] = min(k, least.get(run, k))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and least[tuple(w[i : i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def base_spans(text):
    """(kind, start, end) of the fixed kinds, with the patterns as they are given."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]
