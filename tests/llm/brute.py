"""Plain Python versions of what the numbered operators return."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from serion.llm import language_id, lm_scoring, quality_classifier
from serion.llm.words import NOT_ALNUM, _byte_codes, hash_words, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    """doc_id -> (set size, component) of (doc_id, text) rows."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    have = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for x in s for j in have[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for x in s:
            have[x].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def contamination(docs, items, width=13):
    """(n_words, n_hit, items) per text of docs."""
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((len(w), len(hit), sorted(found)))
    return out


def quality(t):
    """The six base measures."""
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + o for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for o in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def base_scores(rows):
    """(n_tokens, n_known, train_tokens, base_score) per (doc_id, text) row."""
    split = [[*WORD.findall(lower(t)), None] for _, t in rows]
    c = Counter(x for (i, _), w in zip(rows, split, strict=True) if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for w in split]


def language(net, t):
    """(language, score): every filter laid at every place of every window, one text at a time."""
    if not any(c.isalpha() for c in t or ""):
        return "und", 0.0
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    size, wide, probabilities = language_id.WINDOW, max(language_id.WIDTHS), []
    for a in range(0, len(raw), size):
        seen = net.embed[np.frombuffer(raw[a : a + size].ljust(size), np.uint8)]
        top = []
        for f in range(net.filters.shape[1]):
            weights = net.filters[:, f].reshape(wide, -1)
            total = sum(seen[k : size - wide + 1 + k] @ weights[k] for k in range(wide))
            top.append(max(total.max() + net.bias[f], 0))
        x = np.exp((y := np.array(top) @ net.dense + net.dense_bias) - y.max())
        probabilities.append(x / x.sum())
    p = np.array(probabilities, float)
    best = np.log(p + 1e-6).sum(0).argmax()
    return net.langs[best], p.mean(0)[best]


def _mixed(x):
    return int(mix(np.array([x % 2**64], np.uint64))[0])


def grade_features(t):
    """Feature numbers of a text, word by word."""
    words, bare = WORD.findall(t or ""), ALNUM.findall(lower(t))
    if not words:
        return set()
    hashes = {int(h[0]) for h in hash_words(words)} | {int(h[0]) for h in hash_words(bare, NOT_ALNUM)}
    kinds = Counter()
    for w in words:
        runs, total = [], 0
        for b in w.encode():
            kind = 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
            if not runs or runs[-1] != kind:
                runs.append(kind)
                total += int(_byte_codes()[kind]) * pow(0xD6E8FEB86659FD93, len(runs), 2**64)
        kinds[_mixed(total)] += 1
    for k, times in kinds.items():
        level = int(math.log2(len(words) / times))
        hashes.add(_mixed(k + (level + 1) * 0xA24BAED4963EE407))
    hashes.add(_mixed(int(8 * len({lower(w) for w in words}) / len(words)) + 77))
    return {h >> (64 - quality_classifier.BITS) for h in hashes}


def grade_tails(model, t):
    s = sum(float(model.weights[k]) for k in grade_features(t))
    return [1 / (1 + math.exp(x - s)) for x in model.thresholds]


def model_scores(model, rows):
    """log10 probability of each (doc_id, text) row: the forward recursion over its tokens, counts taken afresh."""
    split = [[*(int(h) for h in hash_words([t or ""], lm_scoring.SPACE)[0]), None] for _, t in rows]
    c = Counter(x for (i, _), w in zip(rows, split, strict=True) if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    own = sorted((x for x in c if x is not None), key=lambda x: (-c[x], signed(x)))[: lm_scoring.OWN]
    parts = 1 << lm_scoring.CLASS_BITS
    kind = {x: parts + k for k, x in enumerate(own)} | {None: lm_scoring.END_CLASS}
    kind_of = lambda x: kind.get(x, (x or 0) >> (64 - lm_scoring.CLASS_BITS))
    total = defaultdict(lambda: 0.5)
    for x, n in c.items():
        total[kind_of(x)] += n + (0.5 if kind_of(x) < parts else 0.0)
    out = []
    for w in split:
        score, state = 0.0, None
        for x in w:
            k = kind_of(x)
            state = (model.start if state is None else state @ model.move) * model.emit[k]
            score += math.log10(state.sum()) + math.log10(c[x] + 0.5) - math.log10(total[k])
            state = state / state.sum()
        out.append(score)
    return out
