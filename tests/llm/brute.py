"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def links(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(rows, n=50):
    owner = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            owner.setdefault(b[p : p + n], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if owner[b[p : p + n]] < i:
                cover[p : p + n] = b"\1" * n
        runs = [x for x in bytes(cover).replace(b"\0", b" ").split(b" ") if x]
        out[i] = (len(b), sum(cover), len(runs), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return out


SECRETS = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))


def secrets(t):
    out = []
    for k, (kind, p) in enumerate(SECRETS):
        for m in p.finditer(t or ""):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


PRIVATE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def private(t):
    out = []
    for k, (kind, p) in enumerate(PRIVATE):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15)
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def grams(w, k=5):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def weighted(a, b):
    ca, cb = Counter(a), Counter(b)
    both = sum((ca & cb).values())
    return both / (len(a) + len(b) - both)


def leaks(rows, items, least=0.8):
    """{document: (similarity, item, start, words)} of its best window of any item's size, at any start, without any filter before the similarity but its bound by distinct shingles."""
    out = {}
    gs = [(i, len(w), grams(w)) for i, t in items if (w := WORD.findall((t or "").lower()))]
    for i, t in rows:
        own = grams(WORD.findall((t or "").lower()))
        best = None
        for item, n, g in gs:
            m, some = len(g), set(g)
            shared = [x in some for x in own]
            held = sum(shared[:m])
            for s in range(max(len(own), 1)):
                if held >= least * m - 1e-9:  # the similarity is at most the shared positions over the item's shingles
                    found = (-weighted(own[s : s + m], g), item, s, n)
                    best = found if best is None or found < best else best
                if s < len(own):
                    held += (shared[s + m] if s + m < len(own) else 0) - shared[s]
        if best and -best[0] >= least - 1e-9:
            out[i] = (-best[0], *best[1:])
    return out


def leaked(rows, items):
    return set(leaks(rows, items))
