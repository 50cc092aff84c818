"""Plain definitions of the operators' results, for small tables."""

import hashlib
import itertools
import re

import numpy as np


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(nodes, links):
    """The smallest node that links reach, for each node."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def near_duplicates(docs, percent=85):
    """docs: {doc_id: text}; (set size, component) by doc_id."""
    sets = {d: shingles(t) for d, t in docs.items()}
    links = []
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            links.append((a, b))
    found = groups(sets, links)
    return {d: (len(sets[d]), found[d]) for d in docs}


def near_vectors(rows, threshold=0.93):
    """rows: (vec_id, vector, label), ids distinct; (links, component) by vec_id."""
    def sound(v, label):
        return label is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    links = []
    for (i, u, a), (j, v, b) in itertools.combinations(rows, 2):
        if sound(u, a) and sound(v, b) and a == b and len(u) == len(v):
            x, y = np.array(u, float), np.array(v, float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.append((i, j))
    found = groups([r[0] for r in rows], links)
    return {r[0]: (sum(r[0] in link for link in links), found[r[0]]) for r in rows}


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(text, items, size=10):
    """items: [(item_id, text)]; (words, hit words, items, digest)."""
    words = benchmark_words(text)
    hit, found = set(), set()
    for item, own in items:
        own = benchmark_words(own)
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def judge(url, rules):
    """(host, path, rule, verdict) of a url by rules (verdict, host, path)."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fitting = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fitting, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def main_node(tags, parents, texts, furniture):
    """The selected node by the definition of composite text density, each node summed over its own subtree.

    tags and parents by node; texts: (node, characters, those in links).
    """
    nodes = range(len(tags))

    def within(k, top):
        while k > top:
            k = parents[k]
        return k == top

    def density(k):
        below = [n for n in nodes if n != k and within(n, k)]
        c = sum(size for n, size, _ in texts if within(n, k))
        lc = sum(size for n, _, size in texts if within(n, k))
        all_c, all_lc = sum(t[1] for t in texts), sum(t[2] for t in texts)
        if not c:
            return 0.0
        t, lt = max(len(below), 1), max(sum(tags[n] == "a" for n in below), 1)
        base = c / max(c - lc, 1) * max(lc, 1) + all_lc / max(all_c, 1) * c + np.e
        return max(c / t * np.log(max(c / max(lc, 1) * t / lt, 1)) / np.log(np.log(base)), 0.0)

    found = [density(k) for k in nodes]
    sums = [sum(found[n] for n in nodes if parents[n] == k) for k in nodes]
    fit = [k for k in nodes if not furniture[k] and (sums[k] > 0 or found[k] > 0)]
    if not fit:
        return None
    best = max(fit, key=lambda k: (round(sums[k], 9), any(tags[n] in ("article", "main") and within(k, n) for n in nodes), round(found[k], 9), -k))
    path = [n for n in nodes if within(best, n)]
    least = min(found[k] for k in path)
    return next((k for k in path if found[k] > least), best)


def common_words(text, template):
    """Length of the longest common subsequence of two lists of words."""
    row = [0] * (len(template) + 1)
    for word in text:
        last = 0
        for k, own in enumerate(template):
            last, row[k + 1] = row[k + 1], last + 1 if word == own else max(row[k + 1], row[k])
    return row[-1]


def ftrl_score(rows, labels, vectors, bits, order, alpha, l1, l2, beta=1.0):
    """Probabilities by follow-the-regularised-leader, one coordinate after another."""
    z, n = {}, {}

    def weight(i):
        own = z.get(i, 0.0)
        if abs(own) <= l1:
            return 0.0
        return -(own - np.sign(own) * l1) / ((beta + np.sqrt(n.get(i, 0.0))) / alpha + l2)

    def chance(at, x):
        return 1 / (1 + np.exp(-np.clip(sum(weight(int(i)) * v for i, v in zip(at, x)), -40, 40)))

    for k in order:
        at, x = rows[k]
        error = chance(at, x) - labels[k]
        before = {int(i): weight(int(i)) for i in at}
        for i, v in zip(at, x):
            i, g = int(i), error * v
            sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / alpha
            z[i] = z.get(i, 0.0) + g - sigma * before[i]
            n[i] = n.get(i, 0.0) + g * g
    return [chance(at, x) for at, x in vectors]
