"""Plain versions of the operators' contracts, and small hard cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from marlpit.llm import identifiers

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, k2 int, spans string, tokens string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "be", "ça", "dé", "Eno", "fi", "go", "hu", "it", "jo"]) + rng.choice("abcdefgh") * rng.randint(0, 3) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


def hard_cases(seed=3):
    """(doc_id, text): nulls, blanks, repeats within and across, a long text, repeated rows, ids out of order."""
    rng = random.Random(seed)
    passage, other = prose(rng, 80), prose(rng, 55)
    docs = [None, "", "   \n\t ", "one", "a b c", "x " * 300, "ab" * 400, prose(rng, 30), passage, passage]
    for i in range(40):
        docs.append(prose(rng, rng.randint(0, 60)) + " " + rng.choice([passage, other, passage[:300], ""]) + " " + prose(rng, rng.randint(0, 60)))
    base = prose(rng, 200).split()
    for _ in range(12):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["zz", "qq", "ww"])
        docs.append(" ".join(w))
    docs += ["go hu " * 200, "go hu " * 90 + passage, "it " + "go hu " * 120, "x" * 500, "x" * 300 + passage]
    docs += [prose(rng, 20000), "é" * 150 + "\n" + "é" * 150, "Tab\tand\x0bvt " + other]
    rows = [(i * 7 % 101 - 3, t) for i, t in enumerate(docs)]
    return [*rows, rows[8], rows[8], (rows[11][0], "the same id, another text " + passage), (None, passage), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "x", 2, "y", "z") for d, t in rows], SCHEMA).repartition(3)


def op4(rows, size=50):
    big = (1 << 63) - 1
    key = lambda d: big if d is None else d
    least = {}
    cut = [BLANK.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, cut, strict=True):
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            least[x] = min(least.get(x, big + 1), key(d))
    out = []
    for (d, _), w in zip(rows, cut, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < key(d):
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return Counter(out)


def op7(rows, size=200):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return Counter(out)


def op8(rows, items, size=10):
    windows = defaultdict(set)
    for k, t in items:
        w = ALNUM.findall(lower(t or "")) if k is not None else []
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(k))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in rows:
        w, hit, met = ALNUM.findall(lower(t or "")), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if who := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    met |= who
        out.append((d, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    return Counter(out)


def op10(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = BLANK.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            dup += bool(BLANK.search(x)) and x in seen
            seen.add(x)
        at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    return Counter(out)


def shingles(text, n=5):
    w = BLANK.findall(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def op1(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 63), (1 << 63) - 1 if d is None else d)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = {"email": [m.span() for m in EMAIL.finditer(text)]}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def op3(rows):
    out = []
    for d, t in rows:
        found = pii(t or "")
        out.append((d, *(len(v) for v in found.values()), sha(",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v))))
    return Counter(out)


def bootstrapped(mentions, support=5, confidence=0.8):
    """(instance: kind) that patterns discover, from (kind or None, instance, before, after, shape) tuples, turn by turn."""
    edges = defaultdict(set)
    for kind, instance, before, after, shape in mentions:
        for p in (("<", before), (">", after), ("<>", before and after and (before, after)), ("=", shape)):
            if p[1]:
                edges[p].add(instance)
    known = {(i, k): 1.0 for k, i, *_ in mentions if k}
    unknown = {i for k, i, *_ in mentions if not k}
    while True:
        doubts = defaultdict(lambda: 1.0)
        for p, members in edges.items():
            some = sum(any((i, k) in known for k in identifiers.KINDS) for i in members)
            for kind in identifiers.KINDS:
                score = [known[i, kind] for i in members if (i, kind) in known]
                mean = sum(score) / (some + identifiers.UNKNOWN * (len(members) - some)) if score else 0.0
                if len(score) >= support and mean >= confidence:
                    for i in members & unknown:
                        doubts[i, kind] *= max(1e-9, 1 - mean)
        best = {}
        for (i, kind), d in doubts.items():
            if 1 - d >= confidence and not any((i, k) in known for k in identifiers.KINDS):
                best[i] = max(best.get(i, (0, "")), (1 - d, kind))
        if not best:
            return {i: k for (i, k), _ in sorted(known.items(), key=lambda x: (x[1], x[0][1])) if i in unknown}
        known |= {(i, kind): s for i, (s, kind) in best.items()}
