"""Texts and brute-force versions that several tests use."""

import re

from siltstone.llm import secret_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def words_of(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text, k):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def edited(rng, base, edits):
    w = list(base)
    for i in rng.sample(range(len(w)), min(edits, len(w))):
        w[i] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def linked_roots(texts, k, percent):
    """Set sizes and, for each text, the least index that links lead to, over all pairs."""
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    root, before = list(range(len(texts))), None
    while root != before:
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return [len(s) for s in sets], root


def by_force(text, scope=secret_links.SCOPE):
    """All spans of a text in plain Python: base ones, and weak ones near their complements."""
    base = []
    for kind, pattern in enumerate((secret_links.ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+")):
        for m in re.finditer(pattern.replace("(?i:password|passwd|secret|token|api_?key)", "(?i:(?:password|passwd|secret|token|api_?key))"), text):
            if len(m[1] if kind == 0 else m[0]) >= (12, 18, 16)[kind]:
                base.append((m.start(), kind, m.end()))
    weak = []
    for kind, pattern in ((3, secret_links.IDENTIFIER), (4, secret_links.RANDOM), (5, secret_links.ENDPOINT)):
        for m in re.finditer(pattern, text):
            if kind != 4 or (re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])):
                weak.append((m.start(), kind, m.end()))
    free = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    parts = free + [b for b in base if b[1] < 2]
    near = lambda at, kinds: any(p[1] in kinds and abs(p[0] - at) <= scope for p in parts)
    more = [w for w in free if (w[1] == 5 or near(w[0], (0, 4) if w[1] == 3 else (1, 3))) and (w[1] != 5 or (near(w[0], (1, 3)) and near(w[0], (0, 4))))]
    return sorted(base), sorted(base + more)
