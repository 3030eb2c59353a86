"""Plain forms of the operators over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs):
    sets, parent = [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[root(i)].append(d)
    return sorted((d, len(s), min(least[root(i)])) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def repeats(docs, span=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            first[b[i : i + span]] = min(d, first.get(b[i : i + span], d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def exact(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, (_, t) in enumerate(docs)}
    groups = defaultdict(list)
    for i, n in norm.items():
        groups[n].append(i)
    out = []
    for n, own in groups.items():
        keep = min(own, key=lambda i: (-len(docs[i][1] or ""), docs[i][0]))
        out += [(docs[i][0], docs[keep][0], len(own), docs[i][0] == docs[keep][0], hashlib.sha256(n.encode()).hexdigest()) for i in own]
    return sorted(out)


def contaminated(rows, items):
    """(doc, item) -> similarity of the best window of the item's size, where that is 0.8 at least."""
    out, parted = {}, [(doc, words(text)) for doc, text in rows]
    for item, t in items:
        w = words(t)
        k = min(5, len(w))
        bag = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        for doc, v in parted:
            for s in range(max(1, len(v) - len(w) + 1)):
                x = v[s : s + len(w)]
                own = Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
                both = sum((bag & own).values())
                if both and both >= 0.8 * sum((bag | own).values()):
                    out[doc, item] = max(out.get((doc, item), 0), both / sum((bag | own).values()))
    return out
