"""Plain Python versions of the operators, written from their contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def near_duplicates(rows, k, percent):
    """Per row of (id, text): (id, shingles, smallest id reachable, kept). Null ids reach others and name no one."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    both = Counter()
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                both[h[y], h[x]] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows))


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
)
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
SECRETS = (
    ("assign", ASSIGN, lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
)


def spans(text, kinds, whole=False):
    found = []
    for k, (name, p, ok) in enumerate(kinds):
        found += [(m.start(), k, m.end(), name) for m in re.finditer(p, text or "") if ok(m if whole else m[0])]
    return sorted(found)


def digest(found):
    return hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in found).encode()).hexdigest()


def repeat_words(w):
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)})


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    r = repeat_words(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, r, len(w) < 50 or 100 * r > 50 * len(w)


def passages(rows, shared_words):
    """(id, start, end, words) of runs of sentences that occur earlier, of texts with so many such words; rows of one id must not differ in text."""
    seen, out = set(), set()
    for i, text in sorted(dict(rows).items()):
        at, place = 0, []
        for line in (text or "").split("\n"):
            for m in re.finditer(r"[^.!?]+[.!?]*", line):
                words = re.findall(r"[^\W_]+", m[0])
                if len(words) >= 3:
                    a, b = m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - (len(m[0]) - len(m[0].rstrip()))
                    place.append((" ".join(words).lower(), at + a, at + b, len(words)))
            at += len(line) + 1
        old = [p[0] in seen or p[0] in {q[0] for q in place[:j]} for j, p in enumerate(place)]
        seen |= {p[0] for p in place}
        if sum(p[3] for p, is_old in zip(place, old) if is_old) < shared_words:
            continue
        run = []
        for p, is_old in [*zip(place, old), (None, False)]:
            if is_old:
                run.append(p)
            elif run:
                out.add((i, run[0][1], run[-1][2], sum(q[3] for q in run)))
                run = []
    return out
