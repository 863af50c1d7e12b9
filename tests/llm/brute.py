"""Plain versions of the operators, for small fixtures."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def jaccard(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def substrings(docs, span=20):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if (x := tuple(w[k : k + span])) in seen:
                gone[k : k + span] = [True] * span
            seen.add(x)
        kept = [a for a, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), sha(" ".join(kept)))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def lines_kept(docs, min_sites):
    sites = {}
    for _, text, source in docs:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r"):
                sites.setdefault(line.strip(" \t\r"), set()).add(source)
    out = {}
    for i, text, _ in docs:
        lines = (text or "").split("\n")
        real = [x.strip(" \t\r") != "" for x in lines]
        gone = [r and len(sites[x.strip(" \t\r")]) >= min_sites for x, r in zip(lines, real, strict=True)]
        sizes = [len(x.strip(" \t\r")) for x in lines]
        if sum(n for n, g in zip(sizes, gone, strict=True) if g) * 2 > sum(sizes):
            gone = [False] * len(lines)
        out[i] = (sum(real), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


def corpus(n=60, seed=5):
    """(doc_id, text) with exact copies, near copies, shared passages, short, empty and null texts, odd white space."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda m: " ".join(rng.choice(vocabulary) for _ in range(m))
    passage, base = text(30), text(90)
    docs = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            t = base
        elif kind in (1, 2):
            w = base.split()
            for _ in range(kind * 2):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = "\t".join(w) if kind == 2 else " ".join(w)
        elif kind == 3:
            t = f"{text(20)} {passage}\n{text(25)}"
        elif kind == 4:
            t = text(3)
        elif kind == 5:
            t = ["", None, " \n\t ", "One", "one"][(i // 10) % 5]
        elif kind == 6:
            t = (text(7) + " ") * 8
        else:
            t = text(rng.randint(5, 150)).upper() if kind == 7 else text(rng.randint(5, 150))
        docs.append((i, t))
    docs.append((n, " ".join(vocabulary[k % 400] for k in range(6000))))
    docs.append((n + 1, "漢字 " * 30 + "x" * 5000))
    return docs
