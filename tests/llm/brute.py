"""Plain restatements of the contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def decontamination(docs, items):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and (got := windows.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def shingle_sets(docs, size):
    out = []
    for doc, text in docs:
        w = blank_words(text)
        out.append((doc, {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())))
    return out


def jaccard(docs, size, percent):
    """(doc_id, set size, component) per row, rows by their place."""
    sets = shingle_sets(docs, size)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i))) for i, (doc, s) in enumerate(sets)]


def passages(docs, length):
    first = {}
    ordered = sorted(docs, key=lambda x: x[0])
    for doc, text in ordered:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], (doc, i))
    out = []
    for doc, text in ordered:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] != (doc, i):
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def lines(docs, least):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(UPPER)

    seen = Counter(k for _, text in docs for k in {key(x) for x in (text or "").split("\n")} if k)
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if seen[key(x)] < least]
        out.append((doc, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def secrets(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def unigram(docs, learn):
    def tokens(text):
        return [*blank_words(text), None]

    c = Counter(t for doc, text in docs if learn(doc) for t in tokens(text))
    total, kinds = sum(c.values()), len(c)
    return [(doc, len(tokens(text)), sum(t in c for t in tokens(text)), total,
             sum(math.log10((c[t] + 1) / (total + kinds + 1)) for t in tokens(text))) for doc, text in docs]


def ppm_of_order(text, trained, order):
    """log10 P of the bytes and the end under escape C with exclusion, contexts of `order` bytes and fewer."""
    count = {}
    for t in trained:
        s = [254] * order + [*(t or "").encode(), 255]
        for i in range(order, len(s)):
            for j in range(order + 1):
                count.setdefault(tuple(s[i - j:i]), Counter())[s[i]] += 1
    s, total = [254] * order + [*(text or "").encode(), 255], 0.0
    for i in range(order, len(s)):
        p, out = 1.0, set()
        for j in range(order, -1, -1):
            left = {k: n for k, n in count.get(tuple(s[i - j:i]), {}).items() if k not in out}
            if left:
                whole = sum(left.values()) + len(left)
                if s[i] in left:
                    p *= left[s[i]] / whole
                    break
                p *= len(left) / whole
                out |= set(left)
        else:
            p /= 255 - len(out)
        total += math.log10(p)
    return total


def ppm(text, trained):
    """log10 P of the bytes and the end under escape C with exclusion, contexts of two bytes and fewer."""
    count = {0: Counter(), 1: {}, 2: {}}
    for t in trained:
        s = [254, 254, *(t or "").encode(), 255]
        for i in range(2, len(s)):
            count[0][s[i]] += 1
            count[1].setdefault(s[i - 1], Counter())[s[i]] += 1
            count[2].setdefault((s[i - 2], s[i - 1]), Counter())[s[i]] += 1
    alphabet = set(range(256)) - {254}
    s, total = [254, 254, *(text or "").encode(), 255], 0.0
    for i in range(2, len(s)):
        p, out = 1.0, set()
        for seen in (count[2].get((s[i - 2], s[i - 1]), Counter()), count[1].get(s[i - 1], Counter()), count[0]):
            left = {k: n for k, n in seen.items() if k not in out}
            if left:
                whole = sum(left.values()) + len(left)
                if s[i] in left:
                    p *= left[s[i]] / whole
                    break
                p *= len(left) / whole
                out |= set(left)
        else:
            p /= len(alphabet - out)
        total += math.log10(p)
    return total
