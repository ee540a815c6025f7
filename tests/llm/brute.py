"""Plain versions of what the operators compute, and small documents with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, exact and near copies, repeated rows, a null id."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randrange(1, 8))) for _ in range(400)] + ["Benchmark", "日本", "don't", "x1", "<|endoftext|>"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One  two"), (5, "..!?"), (6, make(20_000))]
    for i in range(10, 40):
        out.append((i, make(rng.choice([3, 30, 120, 400]))))
    base = make(300)
    out += [(i, base) for i in range(50, 56)]
    for i in range(60, 75):
        x = base.split(" ")
        for _ in range(rng.randrange(1, 16)):
            x[rng.randrange(len(x))] = rng.choice(words)
        out.append((i, " ".join(x)))
    shared = make(60)
    out += [(i, make(50) + " " + shared + " " + make(50)) for i in range(80, 90)]
    out += [(91, "ab" * 400), (92, out[10][1]), (92, out[10][1]), (None, base), (None, "alone and lonely here")]
    out += [(95, make(20) + " password: hunter22x AKIA" + "A" * 18 + " and 0123456789abcdef0123456789abcdef é api_key='abc' token=token=abcdefg")]
    out += [(96, "SECRET = \"é\" Secret:abcdef-_. passwd=12345 xoxb-1234567890-abc\n-----BEGIN RSA PRIVATE KEY-----")]
    return out


def contaminated(text, items, n=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    by = defaultdict(set)
    for item, t in items:
        w = pattern.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            by[tuple(w[k : k + n])].add("" if item is None else str(item))
    w = pattern.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for size in {len(k) for k in by}:
        for i in range(len(w) - size + 1):
            if got := by.get(tuple(w[i : i + size])):
                found |= got
                hit.update(range(i, i + size))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def repeated(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def shingles(text, words):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def near(docs, words, percent):
    """Class representative (index) of each document."""
    sets = [shingles(t, words) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sets, [root(i) for i in range(len(docs))]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)
