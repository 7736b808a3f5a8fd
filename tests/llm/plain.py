"""Plain single-process versions of the operators' contracts; rows are (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = rb"[\x20\x09-\x0D]"


def raw(text):
    return (text or "").encode()


def low(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(text))


def words(data):
    return re.findall(rb"[^\x20\x09-\x0D]+", data)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def line_dedup(rows, min_chars=10):
    def key(line):
        line = re.sub(rb"^" + SPACE + rb"+|" + SPACE + rb"+$", b"", line.encode())
        return re.sub(rb"[A-Z]", lambda m: m[0].lower(), line)

    last = float("inf")
    owner = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k.decode()) >= min_chars:
                owner[k] = min(owner.get(k, last), last if d is None else d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), d) in (d, last if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def shingles(text, n=5):
    w = words(low(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(rows, percent=80, n=5):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    by_id = {}
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in held[g])
        links = [j for j, m in common.items() if 100 * m >= percent * (len(s) + len(sets[j]) - m)]
        if s:
            links += by_id.setdefault(rows[i][0], [])
            by_id[rows[i][0]].append(i)
        for j in links:
            root[find(i)] = find(j)
        for g in s:
            held[g].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(float("inf") if d is None else d)
    least = {k: min(v) for k, v in least.items()}
    none = float("inf")
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)] if sets[i] else none if d is None else d
        out.append((d, len(sets[i]), None if c == none else c))
    return out


def decontaminate(rows, items, n=10):
    def cut(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))

    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - n + 1) if w and item is not None else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in rows:
        w, hit, found = cut(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def substring_dedup(rows, window=50):
    last = float("inf")
    owner = {}
    for d, text in rows:
        w = words(raw(text))
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            owner[k] = min(owner.get(k, last), last if d is None else d)
    out = []
    for d, text in rows:
        w, gone = words(raw(text)), set()
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < (last if d is None else d):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), sha(b" ".join(kept))))
    return out
