"""A plain per-row model of the search, for comparison only."""


def _last_row(query, target, first, substitution):
    row = first
    for i, b in enumerate(query.encode(), 1):
        new = [i]
        for j, c in enumerate(target.encode(), 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (0 if b == c else substitution)))
        row = new
    return row


def local_levenshtein(query, target):
    """Unit-cost edits, of bytes, from ``query`` to the nearest substring of ``target``."""
    n = len(target.encode())
    return min(_last_row(query, target, [0] * (n + 1), 1)[1:]) if query and target else len(query.encode())


def prefix_indel(query, target):
    """Inserts and deletes, of bytes, from ``query`` to the nearest non-empty prefix of ``target``."""
    n = len(target.encode())
    return min(_last_row(query, target, list(range(n + 1)), 2)[1:]) if query and target else len(query.encode())

WS = " \t\n\r\f"


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def index_of(needle, hay):
    p = fold(hay).encode().find(fold(needle).encode())
    return p if p >= 0 else None


def tokens(q):
    for w in WS:
        q = q.replace(w, " ")
    return [t for t in q.split(" ") if t]


def term_cost(base, s):
    if base == "":
        return None
    if fold(base) == fold(s):
        return 0
    p = index_of(base, s)
    if p is not None:
        return p * 12000 + (len(s.encode()) - len(base.encode())) * 2500
    d = prefix_indel(base, s)
    return d * 20000 if d < 2 else None


def inversions(ps):
    return sum(8000 for i in range(len(ps)) for j in range(i + 1, len(ps)) if ps[i] > ps[j])


def syllable_match(toks, syl):
    if not toks or len(syl) < len(toks):
        return None
    best = []
    for t in toks:
        tone = int(t[-1]) if t[-1] in "0123456789" else None
        base = t[:-1] if tone is not None else t
        hits = [(term_cost(base, b), i) for i, (b, s_tone) in enumerate(syl) if tone is None or tone == s_tone]
        hits = [h for h in hits if h[0] is not None]
        if not hits:
            return None
        best.append(min(hits))
    ps = [p for _, p in best]
    unmatched = sum((len(syl) + 1 - i) * 10000 for i in range(len(syl)) if i not in ps)
    return sum(c for c, _ in best), unmatched, inversions(ps)


def definition_match(query, toks, defs):
    block = "".join(defs).encode()
    if not defs or not toks or len(query.encode()) <= 2:
        return None
    cost, ps = 5000, []
    for t in toks:
        p = index_of(t, block.decode())
        if p is None:
            return None
        ps.append(p)
        cost += p * 100
        if p > 0 and chr(block[p - 1]) not in WS + "-":
            cost += 5000
    return cost + 8000 * sum(ord(c) > 127 for c in query), 0, inversions(ps)


def search(query, k, entries):
    """[(entry_id, kind, term, unmatched, inversion, total)] of the k best, and the number of candidates."""
    known = {c for e in entries for c in e[1]}
    chars = [c for c in query if c in known]
    toks = tokens(query)
    found = []
    for i, head, syl, defs, static, *_ in entries:
        m = syllable_match(toks, syl)
        if m:
            found.append((sum(m) + static, static, i, 0, "Jyutping", m))
            continue
        m = definition_match(query, toks, defs)
        if m:
            found.append((sum(m) + static, static, i, 1, "English", m))
        if chars and all(c in head for c in chars):
            found.append((static, static, i, 2, "Traditional", (0, 0, 0)))
    found.sort()
    return [(i, kind, *m, total) for total, _, i, _, kind, m in found[:k]], len(found)
