"""Plain versions of the contracts, and rows with every defined edge case."""

import hashlib
import re
from collections import Counter, defaultdict

LAST = 2**63 - 1
BLANK = " \t\n\x0b\x0c\r"
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Names that operators use inside; as extra columns they must not matter.
CLASHES = ["id", "t", "n", "key", "h", "pos", "row", "kept", "component", "first", "batch", "label", "size", "spans", "p", "g",
           "x", "y", "node", "sig", "_id", "_t", "_l", "_row", "_key", "_bucket", "base", "tokens", "gone", "mix_taken"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)

A = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn near the river bank today " * 2
PASSAGE = ("a passage of more than four hundred bytes that is found in several documents and must be seen wherever it stands, "
           "with neither its place nor what comes before and after it being of any matter to the search, so that each copy "
           "of it is found again although the rest of the text differs from one document to the next one in every word, and "
           "a few more words are added here to make sure that the limit of four hundred bytes is passed by some margin.")


def rows():
    """(doc_id, text, lang, source) with nulls, blanks, ties, repeats, very long texts."""
    long = " ".join(f"w{i * i % 7919}x{i}" for i in range(30000))
    out = [
        (1, A, "en", "a"), (2, A, "en", "b"), (2, A, "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, long, "en", "a"),
        (6, " \n\t\n  ", None, "b"), (7, "word", "de", None), (7, "another text under the same id", "de", "c"), (None, A, "en", "a"),
        (None, "text without an id\nits second line is here", None, "c"), (8, A + " with an addition", "en", "c"),
        (9, "Line of some length\nline of some LENGTH \nshort\nTail of nine", "en", "a"), (10, "  line of some length\nshort\nother end", "en", "b"),
        (11, "x" * 50 + PASSAGE + "y" * 70, "en", "a"), (12, "Über " + PASSAGE + PASSAGE, "de", "a"), (13, "ab " * 400, "en", "b"),
        (14, "released under the MIT License. Apache License, Version 2.0; CC-BY-NC 4.0 and cc by nc", "en", "c"),
        (15, "token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" AKIA" + "Z9" * 10 + " äö password: short secret:=longer+value", "en", "c"),
        (16, "12345 67890 ... !!", None, "c"),
    ]
    return out


def edge_docs(spark):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), *["clash"] * len(CLASHES)) for i, t, la, s in rows()], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def license_base(text):
    words = LETTER_WORD.findall((text or "").translate(TO_LOWER))
    found = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(k for _, k, _ in spans)
    written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return n[0], n[1], n[2], hashlib.sha256(written.encode()).hexdigest()


def shingles(text, size):
    words = BLANK_WORD.findall((text or "").translate(TO_LOWER))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def near_classes(docs, size=3, percent=85):
    """[(id, text)] -> per row (n_shingles, component, kept)."""
    sets = [shingles(t, size) for _, t in docs]
    ids = [LAST if i is None else i for i, _ in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(docs)):
        least[root(i)] = min(least.get(root(i), LAST), ids[i])
    return [(len(sets[i]), least[root(i)], ids[i] == least[root(i)]) for i in range(len(docs))]


def repeats(texts, window=400):
    """Per text (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[s : s + window] for d in data for s in range(len(d) - window + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for s in range(len(d) - window + 1):
            if count[d[s : s + window]] > 1:
                covered[s : s + window] = b"\1" * window
        spans = len([1 for m in re.finditer(b"\1+", bytes(covered))])
        kept = bytes(b for b, c in zip(d, covered) if not c)
        out.append((len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def line_dedup(docs, least=10):
    """[(id, text)] -> per row (n_lines, n_dropped, kept text)."""
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(TO_LOWER)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(LAST if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == (LAST if i is None else i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def targets(sizes, weights=(1, 2, 3), cap=3):
    """source -> target by plain water filling, in fractions."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = Fraction(sum(sizes.values())), set(names), {}
    while free:
        share = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * share > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * share for s in free}
        for s in full:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        free -= full
    return out


def finite(v, limit=8192):
    return v is not None and all(x is not None and abs(x) < limit for x in v)


def codebooks(rows, parts=16, entries=64, rounds=2):
    """[(id, label, v)] of one length -> ([(id, label, code, error)], sha256)."""
    x = [[int(256 * c // 1) for c in v] for _, _, v in rows]
    d = len(x[0])
    cut = [[r[p * d // parts : (p + 1) * d // parts] for r in x] for p in range(parts)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:entries]
    books = [[c[i] for i in first] for c in cut]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = defaultdict(list)
            for v in cut[p]:
                mine[near(v, book)[1]].append(v)
            books[p] = [[sum(c) // len(c) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(book)]
    out = []
    for i, (key, label, _) in enumerate(rows):
        got = [near(cut[p][i], books[p]) for p in range(parts)]
        out.append((key, label, "".join(f"{k:02x}" for _, k in got), sum(s for s, _ in got)))
    written = ",".join(str(c) for book in books for e in book for c in e)
    return out, hashlib.sha256(written.encode()).hexdigest()


def hard_negatives(rows, every=100, positives=5, negatives=10):
    """[(id, label, v)] of one length -> rows of the contract."""
    x = {i: (la, [int(256 * c // 1) for c in v]) for i, la, v in rows}
    out = []
    for a in (i for i in x if i % every == 0):
        score = {i: sum(p * q for p, q in zip(v, x[a][1])) for i, (_, v) in x.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if x[i][0] == x[a][0]][:positives]:
            some = [i for i in order if x[i][0] != x[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:negatives]
            out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(some, 1)]
    return out


def quality_base(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if BLANK_WORD.search(x) and x in lines[:i])
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed
