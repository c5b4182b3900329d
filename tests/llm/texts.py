"""Small corpora and plain versions of what the operators compute."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Prose with exact and near copies, shared passages, and every odd case."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 220)) for _ in range(n)]
    passage = prose(rng, 70)
    out = list(base)
    out += base[:5] + [base[0]] * 6
    for text in base[5:20]:
        w = text.split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(rng, 30)}\n{passage} \t{prose(rng, 30)}" for _ in range(6)]
    out += [None, "", " \n\t ", "one", "two words", "é ß 漢 \U0001f600 x\x1cy", "same " * 120, "same " * 121, "A B c D e F", "a b C d E f", prose(rng, 9000)]
    return [(k, t) for k, t in enumerate(out)]


def removed(docs, window=50):
    """doc_id -> (n_words, n_removed, sha256) by comparing every window with all documents."""
    least = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, t in docs:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs, percent=75):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = groups(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def rule_counts(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)
