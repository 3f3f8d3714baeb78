"""Plain Python versions of the corpus operators, for small tables."""
import collections
import hashlib
import math
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text, k):
    w = spaced(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k, num, den):
    """doc_id -> (set size, smallest linked doc_id); rows: (doc_id, text) with distinct ids."""
    sets = {d: shingles(t, k) for d, t in rows}
    have = collections.defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            have[s].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for d in sets:
        for e, both in collections.Counter(e for s in sets[d] for e in have[s] if e < d).items():
            if both * den >= num * (len(sets[d]) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def unigram(rows, held):
    """doc_id -> (tokens, known, base score), and the number of training tokens."""
    c = collections.Counter()
    for d, t in rows:
        if not held(d):
            c.update(spaced(t))
            c["\n"] += 1
    total, kinds = sum(c.values()), len(c)
    out = {}
    for d, t in rows:
        w = [*spaced(t), "\n"]
        out[d] = len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w)
    return out, total


def cut_repeats(rows, width=50):
    """doc_id -> (bytes, removed, runs, digest of the rest)."""
    first, raw = {}, {d: (t or "").encode() for d, t in rows}
    for d in sorted(raw):
        for i in range(len(raw[d]) - width + 1):
            first.setdefault(raw[d][i:i + width], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i:i + width]] < d:
                gone[i:i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))
    return out


def kept_lines(rows, width=3):
    """doc_id -> text without later occurrences of windows of lines."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines, gone = (t or "").split("\n"), set()
        for i in range(len(lines) - width + 1):
            window = tuple(lines[i:i + width])
            if not "".join(window).strip(" \t\r\x0b\x0c"):
                continue
            if window in seen:
                gone.update(range(i, i + width))
            seen.add(window)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def hits(text, items, window=10):
    """Words, hit words, and ids of items that occur."""
    w, hit, found = plain(text), set(), set()
    for item, other in items:
        iw = plain(other)
        for k in {min(len(iw), window)} - {0}:
            wanted = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in wanted:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(w), len(hit), found


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def phrases(text):
    """Words, places of the phrases, their labels."""
    w, at, labels = plain(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), sorted(at), sorted(labels)
