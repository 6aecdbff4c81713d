"""Plain restatements of what the operators promise, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text: str | None, word=SPACE_WORD, k: int = 5) -> set:
    w = word.findall(lower_ascii(text))
    if len(w) >= k:
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def components(pairs, nodes) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def jaccard_components(rows, percent: int = 80) -> dict:
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links = [
        (a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n]
        if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return components(links, [i for i, _ in sets])


def quality(text: str | None) -> tuple:
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [line for line in text.split("\n") if SPACE_WORD.search(line)]
    triples = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(text: str | None) -> tuple:
    w = ALNUM_WORD.findall(lower_ascii(text))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def secret_base(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    name = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(start, end, kind) for start, _, kind, end in sorted(found)]


def contained(rows, items, percent: int = 80) -> dict:
    """Shared shingles of each text and item found; short items stand word by word anywhere in the text."""
    def shared(text, item):
        w, own = ALNUM_WORD.findall(lower_ascii(text)), ALNUM_WORD.findall(lower_ascii(item))
        if len(own) < 5:
            return int(any(w[j:j + len(own)] == own for j in range(len(w) - len(own) + 1))) if own else 0
        s = shingle_set(item, ALNUM_WORD)
        n = len(shingle_set(text, ALNUM_WORD) & s)
        return n if 100 * n >= percent * len(s) else 0

    return {(d, i): n for d, t in rows for i, item in items if (n := shared(t, item))}
