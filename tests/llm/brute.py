"""Plain versions of the operators, for small inputs, and a small corpus with hard cases."""

import hashlib
import random
import re
from collections import Counter

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=3):
    """Documents that share passages, with copies, near copies, runs of one word, nulls, empties and repeated rows."""
    rng = random.Random(seed)
    words = ["a", "BB", "the", "of", "xé", "zz_zz", "中文"] + [f"w{i}" for i in range(80)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 140))] for _ in range(20)]
    texts = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            parts += b[i : i + rng.randint(1, 110)]
        if rng.random() < 0.3:
            parts += ["a"] * rng.randint(1, 90)
        if rng.random() < 0.3:
            parts += ["a", "BB"] * rng.randint(1, 60)
        texts.append(rng.choice([" ", "  ", "\n", " \t"]).join(parts))
    for _ in range(25):  # near copies of one document
        own = list(base[0] * 2)
        for _ in range(rng.randint(1, 12)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(500)}"
        texts.append(" ".join(own))
    texts += [None, "", "   ", texts[5], texts[5].upper(), "a b", "A  b", "a b c d e"]
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], (rows[7][0], "another text under an id that is taken")]


def suffix(rows, span):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + span] for _, b in bodies for p in range(len(b) - span + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def recompression(rows, span):
    docs = [(i, BLANK_WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for p in range(len(w) - span + 1):
            k = tuple(w[p : p + span])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in docs:
        gone = [0] * len(w)
        for p in range(len(w) - span + 1):
            if least[tuple(w[p : p + span])] < i:
                gone[p : p + span] = [1] * span
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    return sorted((i, max(groups[fold(t)]), len(groups[fold(t)]), i == max(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows)


def shingles(text, size=5):
    w = BLANK_WORD.findall(fold(text))
    return {tuple(w[p : p + size]) for p in range(max(len(w) - size + 1, 1))} if w else set()


def near(rows, threshold=75):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and (i == j or 100 * len(a & b) >= threshold * len(a | b)):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(least.get(root(x), i), i)
    return sorted((i, len(s), least[root(x)] if s else i, i == (least[root(x)] if s else i)) for x, (i, s) in enumerate(sets))


def decontaminated(rows, bench, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, t in bench:
        w = word.findall(fold(t))
        for p in range(max(len(w) - window + 1, 1) if w else 0):
            windows.setdefault(tuple(w[p : p + window]), set()).add(item)
    out = []
    for i, t in rows:
        w = word.findall(fold(t))
        hit, items = set(), set()
        for g, own in windows.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    items |= own
        listed = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(listed), listed, bool(hit)))
    return sorted(out)
