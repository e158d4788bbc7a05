"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text: str | None, k: int) -> set[tuple]:
    words = WORD.findall(fold_ascii(text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest id that links reach from each."""
    least = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def jaccard_links(docs: dict[int, str | None], k: int, percent: int) -> list[tuple[int, int]]:
    sets = {d: shingle_set(t, k) for d, t in docs.items()}
    ids = [d for d in sorted(docs) if sets[d]]
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def kept_words(docs: dict[int, str | None], window: int) -> dict[int, list[str]]:
    """Words that no window covers which also starts in a document with a smaller id."""
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    first: dict[tuple, int] = {}
    for d in sorted(docs):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def leak_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bags(words: list[str], k: int) -> list[tuple]:
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def leak_similarity(text: str | None, item: str | None, k: int) -> float:
    """The best weighted Jaccard similarity of an item-sized window of the text that is aligned with a shared shingle."""
    a, b = bags(leak_words(text), k), bags(leak_words(item), k)
    places: dict[tuple, list[int]] = {}
    for j, s in enumerate(b):
        places.setdefault(s, []).append(j)
    best, whole = 0.0, Counter(b)
    for start in {max(0, min(i - j, len(a) - len(b))) for i, s in enumerate(a) for j in places.get(s, ())}:
        window = Counter(a[start : start + len(b)])
        common = sum((window & whole).values())
        best = max(best, common / (sum(window.values()) + len(b) - common))
    return best


def best_window(text: str | None, item: str | None, k: int) -> tuple[float, int]:
    """The best weighted Jaccard similarity of all item-sized windows of the text, and how many windows reach 0.8."""
    a, b = bags(leak_words(text), k), bags(leak_words(item), k)
    best, n, whole = 0.0, 0, Counter(b)
    for start in range(max(0, len(a) - len(b)) + 1 if a and b else 0):
        window = Counter(a[start : start + len(b)])
        common = sum((window & whole).values())
        best = max(best, common / (sum(window.values()) + len(b) - common))
        n += 100 * common >= 80 * (sum(window.values()) + len(b) - common)
    return best, n
