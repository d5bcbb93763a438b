"""Row-at-a-time versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import random


def docs_frame(spark, rows, extra: bool = True):
    """(doc_id, text) as a table, with extra columns whose names the operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(*r, "x", 1.5, "y", 3) for r in rows]
    schema = "doc_id long, text string, digest string, size double, seed string, row int"
    return spark.createDataFrame(rows, schema)


def corpus(seed: int, n: int = 60, words: int = 400) -> list[tuple]:
    """Texts with copies, near copies, shared passages, empty, null and short ones, and odd characters."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéßñ日") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts: list[str | None] = [None, "", " \n\t", "One", "one  two", "a b c", "A b c  d"]
    while len(texts) < n:
        kind = rnd.random()
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, words))]
        if kind < 0.25 and len(texts) > 10:
            own = (rnd.choice(texts[7:]) or "").split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        elif kind < 0.5:
            at = rnd.randrange(len(own))
            own[at:at] = passage[rnd.randint(0, 20) : rnd.randint(35, 60)]
        elif kind < 0.6:
            own = own[:5] * rnd.randint(1, 30)
        texts.append((" " if kind < 0.8 else "\n").join(own))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows


def words_of(text) -> list[bytes]:
    return (text or "").encode().split()


def repeats(rows, length: int = 20) -> dict:
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = words_of(text)
        gone = [False] * len(words)
        for at in range(len(words) - length + 1):
            window = tuple(words[at : at + length])
            if window in seen:
                gone[at : at + length] = [True] * length
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def jaccard_components(rows, width: int, of: int) -> list[tuple]:
    """(doc_id, size of the set, smallest doc_id of the component) of every row."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in words_of(text)]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= of * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    names = {r: min((d for d in docs if d is not None), default=None) for r, docs in least.items()}
    return [(doc, len(sets[i]), names[find(i)]) for i, (doc, _) in enumerate(rows)]
