"""Plain loops that several tests compare with."""


def shingles(text, width=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def roots_of(texts, least=0.8):
    """The least place of each text's group of near copies."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]
