"""Plain versions of what the operators compute, for small tables."""

import bisect
import collections
import hashlib
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BARE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def repeated(rows, length=100):
    """op1 for {(doc_id, text)} in the order of documents: (n_bytes, n_removed, n_spans, digest) by row."""
    seen, out = set(), {}
    for doc, raw in rows:
        gone = bytearray(len(raw))
        mine = []
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\x01" * length
            else:
                seen.add(w)
            mine.append(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc, raw] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def contaminated(text, items, window=10):
    wins = collections.defaultdict(set)
    for name, t in items:
        w = BARE.findall(low(t or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add("" if name is None else str(name))
    w = BARE.findall(low(text or ""))
    hit, found = set(), set()
    for size in {len(x) for x in wins}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found |= wins[tuple(w[i : i + size])]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def shingles(text, width):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def groups(rows, width, percent=80):
    """Smallest id reachable from each id; rows are (doc_id, text), ids not null."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def bootstrapped(rows, occurrences_of, kinds, support=3, least=0.6, rounds=3):
    """op10's spans for rows of (doc, text): contexts, pattern counts and rounds of scoring, one at a time."""
    totals, seen = collections.Counter(), []
    for doc, text in rows:
        text = text or ""
        lowered = low(text)
        words = [(m.start(), m.end(), m[0]) for m in BARE.finditer(lowered)]
        starts = [w[0] for w in words]
        for k in range(len(words) - 1):
            totals[0, words[k][2], words[k + 1][2]] += 1
            totals[2, words[k][2], lowered[words[k][1] : words[k + 1][0]]] += 1
        for k in range(len(words) - 2):
            totals[1, words[k][2], words[k + 2][2]] += 1
        for o in occurrences_of(text):
            left, right = bisect.bisect_left(starts, o["start"]), bisect.bisect_left(starts, o["end"])
            patterns = []
            if left > 1:
                patterns.append((0, words[left - 2][2], words[left - 1][2]))
            if left and right < len(words):
                patterns.append((1, words[left - 1][2], words[right][2]))
            if left and left < len(words):
                patterns.append((2, words[left - 1][2], lowered[words[left - 1][1] : words[left][0]]))
            seen.append((doc, text, o["start"], o["end"], o["kind"], (max(o["kind"], -1), lowered[o["start"] : o["end"]]), patterns))
    graph = collections.Counter((p, instance, kind) for *_, kind, instance, patterns in seen for p in patterns)
    seeds = {(p, i, k): (1.0, n) for (p, i, k), n in graph.items() if k >= 0}
    weighed, accepted, known, turn = dict(seeds), set(), set(), 0
    while True:
        turn += 1
        sums = collections.defaultdict(lambda: [0.0, 0, 0])
        for (p, _, k), (score, n) in weighed.items():
            sums[p, k][0] += score * n
            sums[p, k][1] += n
            sums[p, k][2] += 1
        trust = {pk: min(s / max(own, totals[pk[0]]), 0.999) for pk, (s, own, c) in sums.items() if c >= support}
        grown = {p for p, _ in trust} - known
        known |= grown
        doubt = collections.defaultdict(lambda: 1.0)
        for (p, i, k), _ in graph.items():
            if k < 0:
                for kind in range(len(kinds)):
                    doubt[i, kind] *= 1 - trust.get((p, kind), 0.0)
        sure = {ik: 1 - d for ik, d in doubt.items() if 1 - d >= least}
        more = set(sure) - accepted
        if turn >= rounds and not grown and not more:
            break
        accepted |= more
        weighed = dict(seeds) | {(p, i, kind): (sure[i, kind], n) for (p, i, k), n in graph.items() if k < 0 for kind in range(len(kinds)) if (i, kind) in sure}
    out = collections.defaultdict(dict)
    for doc, text, start, end, kind, instance, patterns in seen:
        for p, k in itertools.product(patterns, range(len(kinds))):
            if trust.get((p, k), 0.0) >= least:
                if kind < 0 and (instance, k) in sure:
                    out[doc, text].setdefault((start, end), []).append((sure[instance, k], -k))
                elif kind == k == len(kinds) - 1:
                    out[doc, text].setdefault((start, end), []).append((1.0, -k))
    result = {}
    for doc, text in rows:
        spans, reach = personal(text), -1
        for (s, e), best in sorted(out[doc, text or ""].items(), key=lambda x: (x[0][0], -x[0][1])):
            if e > reach:
                spans.append((s, -max(best)[1], e))
            reach = max(reach, e)
        result[doc, text or ""] = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return result
