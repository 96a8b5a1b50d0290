"""Documents for the tests, and brute-force versions of the operators' results."""

import hashlib
import random
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, chunk string, n_words string, kept string, h int"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prose(rng, n):
    syllables = "the of and ing er tion ou ea st é ü ß 12 x".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, near and exact copies, passages in common, and clashing columns."""
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 200)
    near = base.split()
    near[100] = "changed"
    long = prose(rng, 30_000)
    texts = [None, "", " ", "\n\n\t", "word", "one two three four", base, base, " ".join(near), passage, f"{prose(rng, 50)} {passage} {prose(rng, 40)}", f"{prose(rng, 30)}\n{passage}", "a " * 400, "a" * 3000, long, long + " tail", prose(rng, 80) + "\n" + prose(rng, 80), "ÀÉ ▁x▁ 日本語 " * 30, "  two  spaces  "]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(6, base), (40, base), (None, base), (None, None), (41, prose(rng, 100).upper())]
    return [(i, t, "en" if k % 2 else None, "s", 1, 0.5, "c", "w", "k", 7) for k, (i, t) in enumerate(rows)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    """(place, doc_id, text) by doc_id (none first) and text, as repeats are judged."""
    return sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1].encode()))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def covered(units, length, seen):
    mask = bytearray(len(units))
    for p in range(len(units) - length + 1):
        w = units[p : p + length]
        w = bytes(w) if isinstance(w, (bytes, bytearray)) else tuple(w)
        if w in seen:
            mask[p : p + length] = b"\1" * length
        else:
            seen.add(w)
    return mask


def brute_suffix(rows, length=100):
    seen, out = set(), []
    for i, t in ordered(rows):
        b = t.encode()
        m = covered(b, length, seen)
        spans = sum(1 for k in range(len(b)) if m[k] and (not k or not m[k - 1]))
        out.append((i, len(b), sum(m), spans, sha(bytes(x for x, y in zip(b, m, strict=True) if not y))))
    return out


def brute_words(rows, length=20):
    seen, out = set(), []
    for i, t in ordered(rows):
        w = t.encode().split()
        m = covered(w, length, seen)
        out.append((i, len(w), sum(m), sha(b" ".join(x for x, y in zip(w, m, strict=True) if not y))))
    return out


def gram_sets(rows, n=5):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().translate(LOWER).split()
        out.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    return out


def brute_join(rows, n=5, percent=80):
    sets = gram_sets(rows, n)
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, s) for i, s in sets if i is not None and s]
    for a in range(len(own)):
        for b in range(a):
            (i, s), (j, t) = own[a], own[b]
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def brute_decontaminate(rows, items, window=10):
    word = lambda b: b >= 128 or chr(b).isalnum()
    fold = lambda t: bytes(b if word(b) else 32 for b in (t or "").encode().translate(LOWER)).split()
    windows = defaultdict(set)
    for i, t in items:
        w = fold(t)
        if w:
            for k in range(max(1, len(w) - window + 1)):
                windows[tuple(w[k : k + window])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t, *_ in rows:
        w, hit, found = fold(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def brute_quality(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    seen = defaultdict(list)
    for k in range(len(words) - 2):
        seen[tuple(words[k : k + 3])].append(k)
    repeat = {k + d for at in seen.values() if len(at) > 1 for k in at for d in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words)


def same(got, want):
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
