"""Plain versions of the operators over small lists of (doc_id, text), to test against."""

from __future__ import annotations

import hashlib
import re


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def big(doc_id):
    return float("inf") if doc_id is None else doc_id


def line_dedup(rows, min_chars=10):
    key = lambda line: re.sub(r"[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    first: dict[str, float] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, float("inf")), big(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or big(doc) == first[key(x)]]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def substring_dedup(rows, length=35):
    cut = [words(t) for _, t in rows]
    count: dict[tuple, int] = {}
    for w in cut:
        for i in range(len(w) - length + 1):
            count[tuple(w[i : i + length])] = count.get(tuple(w[i : i + length]), 0) + 1
    out = []
    for (doc, _), w in zip(rows, cut):
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def jaccard_components(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        w = [re.sub(r"[A-Z]+", lambda m: m[0].lower(), x) for x in words(text)]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict[int, float] = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), float("inf")), big(doc))
    return [(doc, len(sets[i]), doc if not sets[i] else None if least[find(i)] == float("inf") else least[find(i)]) for i, (doc, _) in enumerate(rows)]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out
