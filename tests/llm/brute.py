"""Plain Python for the results of the operators, and a small table with every awkward case."""

import hashlib
import math
import random
import re
import struct

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def documents(seed=0):
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, copies, near copies, shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, family = say(70), say(160).split()
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, "one", "en", None), (4, "One two three", "de", "b"), (5, "one two three", "de", "b"), (6, "1234 5678", None, "b")]
    rows += [(10 + i, say(rng.randint(3, 200)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(30)]
    rows += [(50 + i, say(20) + " " + passage + "\n" + say(20), "en", "hot") for i in range(12)]
    copy = say(150)
    rows += [(70 + i, copy, "en", "hot") for i in range(25)]
    for i in range(40):
        own = list(family)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(own), "en", "hot"))
    rows += [(None, say(40) + " " + passage + " " + passage, "en", "a"), (200, say(6000), "en", "a"), (201, say(30) + " " + (say(60) + " ") * 3, "en", "a"), (202, "x" * 5000, "en", "c"), (203, "the same line\n" * 30, "en", "c")]
    rows += [(300 + i, f"{say(60)} token: {'Zq8' * 5} {say(20)} k9Xv2Qz7LmP0aWs8Yt3RbN6c{i} {say(9)}", "en", "abc"[i % 3]) for i in range(9)]
    rng.shuffle(rows)
    return rows


def removed_bytes(rows, size=100):
    seen, out = set(), {}
    for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r)):
        raw = text.encode()
        if i is None:  # earlier than no other row, and no other is earlier
            seen = set()
        gone = [False] * len(raw)
        for s in range(len(raw) - size + 1):
            w = raw[s : s + size]
            if w in seen:
                gone[s : s + size] = [True] * size
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def removed_words(rows, size=50):
    first = {}
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    for i in sorted(x for x in words if x is not None):
        for s in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][s : s + size]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and first[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, percent=75):
    sets, nameless = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}, {None: (len(shingles(r[1])), None) for r in rows if r[0] is None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids} | nameless


def near_kept(rows, percent=75):
    """Which rows the near-duplicate stage keeps, by row and not by id: for each row its number, or nothing if it goes."""
    sets = [shingles(r[1]) for r in rows]
    use = [k for k, r in enumerate(rows) if r[0] is not None and sets[k]]
    up = {k: k for k in use}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(use):
        for b in use[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[root(b)] = root(a)
    classes = {}
    for k in use:
        classes.setdefault(root(k), []).append(k)
    kept = {k for k in range(len(rows)) if k not in up}
    for members in classes.values():
        least = min(rows[k][0] for k in members)
        longest = max(len(rows[k][1]) for k in members if rows[k][0] == least)
        kept.add(min(k for k in members if rows[k][0] == least and len(rows[k][1]) == longest))
    return kept


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(repeated)


def phrases(rows, items, size=10):
    windows = {}
    for name, text in items:
        w = BENCH_WORD.findall((text or "").translate(ASCII_LOWER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).update([] if name is None else [str(name)])
    out = {}
    for i, text in rows:
        w = BENCH_WORD.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


SECRET_ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


def base_secrets(text):
    """(start, number of kind, end) in code points."""
    out = [(m.start(), 0, m.end()) for m in SECRET_ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32])


def secrets(text, encode):
    """Base spans and all spans: of parts of runs beside base spans, those of at most two characters a token."""
    base, more = base_secrets(text or ""), []
    inside = {p for a, _, b in base for p in range(a, b)}
    for m in RUN.finditer(text or ""):
        at = m.start()
        for own in re.split("\0+", "".join("\0" if p in inside else c for p, c in enumerate(m.group(), at))):
            begin = (text or "").index(own, at) if own else at
            at = begin + len(own)
            digest = len(own) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-f]+|[0-9A-F]+", own)
            if len(own) >= 20 and re.search("[A-Za-z]", own) and not digest and not UUID.fullmatch(own) and len(own) <= 2.0 * len(encode(own)):
                more.append((begin, 3, begin + len(own)))
    return base, sorted(base + more)


def said(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in spans)


def masked(text, spans, mask="[secret]"):
    out, done = "", 0
    for a, _, b in spans:
        if a >= done:
            out += text[done:a] + mask
        done = max(done, b)
    return out + text[done:]


def uniform(doc_id, seed=11):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest("" if doc_id is None else str(doc_id), 42))
    return ((h - (h >> 63 << 64)) % (1 << 52) + 0.5) / (1 << 52)


def mixing(rows):
    """rows: (doc_id, source, size); for each: source_size, target, copies."""
    total = {}
    for _, source, size in rows:
        total[source] = total.get(source, 0) + size
    names = sorted(total, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight, target, open_ = {s: 1 + k % 3 for k, s in enumerate(names)}, {}, set(names)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s] + 1e-9}
        target |= {s: 3.0 * total[s] for s in over} if over else share
        open_ -= over
        if not over or not open_:
            break
    out = [None] * len(rows)
    for s in names:
        own = [k for k, r in enumerate(rows) if r[1] == s]
        lo, hi = 0.0, 1e6
        for _ in range(200):  # expected words grow with the factor
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(3, mid * rows[k][2] ** 0.5) * rows[k][2] for k in own) < target[s] - 1e-9 else (lo, mid)
        expected = {k: min(3.0, hi * rows[k][2] ** 0.5) for k in own}
        copies = {k: math.floor(expected[k] + 1e-6) for k in own}
        chance = {k: max(0.0, expected[k] - copies[k]) for k in own}
        need = target[s] - sum(copies[k] * rows[k][2] for k in own)

        def rank(k, chance=chance):
            u, p = uniform(rows[k][0]), chance[k]
            return (u / (1 - u)) * (1 - p) / p if p > 1e-6 else math.inf

        order = sorted((k for k in own if copies[k] < 3), key=lambda k: (rank(k), rows[k][2]))
        got, first = 0, set()
        for k in order if need > 1e-6 else ():
            if got + rows[k][2] > need + 1e-6:
                break
            got += rows[k][2]
            first.add(k)
        left, second, got = need - got, set(), 0
        for k in order if left > 1e-6 else ():
            if k not in first and rows[k][2] <= left:
                if got + rows[k][2] > left and 2 * (left - got) <= rows[k][2]:
                    break
                got += rows[k][2]
                second.add(k)
                if got > left:
                    break
        for k in own:
            out[k] = (total[s], target[s], copies[k] + (k in first) + (k in second))
    return out


def decontaminated(text, items, size=10):
    """The text without words of benchmark phrases (with what lies between neighbours); None if no word is left."""
    windows = set()
    for _, t in items:
        w = BENCH_WORD.findall((t or "").translate(ASCII_LOWER))
        n = min(size, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    found = list(BENCH_WORD.finditer((text or "").translate(ASCII_LOWER)))
    words, hit = [m.group() for m in found], set()
    for n in {len(x) for x in windows}:
        hit |= {p for s in range(len(words) - n + 1) if tuple(words[s : s + n]) in windows for p in range(s, s + n)}
    if hit and len(hit) == len(words):
        return None, True
    out, done, p = "", 0, 0
    while p < len(words):
        if p in hit:
            last = p
            while last + 1 in hit:
                last += 1
            out += text[done : found[p].start()]
            done, p = found[last].end(), last
        p += 1
    return (None if text is None else out + text[done:]), False


def pipeline(rows, items, rejects, encode):
    """rows: (doc_id, text, lang, source); rejects: the learned rules on statistics.  (doc_id, text, source, size, target, taken,
    copy) of every row of the corpus."""
    stats = [statistics(r[1]) for r in rows]
    rows = [r for r, s in zip(rows, stats, strict=True) if s[0] >= 50 and 100 * s[4] <= 50 * s[0] and not rejects(r[1])]
    kept = near_kept(rows)
    rows = [r for k, r in enumerate(rows) if k in kept]
    rows = [(r[0], *decontaminated(r[1], items), r[3]) for r in rows]
    rows = [(i, t if t is None else masked(t, secrets(t, encode)[1]), s) for i, t, gone, s in rows if not gone]
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    mixed = mixing([(i, s, n) for (i, _, s), n in zip(rows, sizes, strict=True)])
    return [(i, t, s, n, round(goal, 6), n * c, k + 1) for (i, t, s), n, (_, goal, c) in zip(rows, sizes, mixed, strict=True) for k in range(c)]
