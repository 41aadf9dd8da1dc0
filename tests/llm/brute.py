"""Plain-Python versions of the contracts, to hold the operators' results against. Each takes lists of dicts."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def op1(docs):
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    common = Counter((a, b) for ids in where.values() for a in ids for b in ids if a < b)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def op2(docs):
    out = {}
    for d in docs:
        s = base_secrets(d["text"])
        n = Counter(x.split(":")[0] for x in s)
        out[d["doc_id"]] = (n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(s).encode()).hexdigest(), s)
    return out


def op3(rows, every=50, k=5):
    ok = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]] for r in rows if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            got = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(got)}
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def op4(docs):
    c = Counter(t for d in docs if not held(d["doc_id"]) for t in [*words(d["text"]), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for d in docs:
        toks = [*words(d["text"]), None]
        out[d["doc_id"]] = (held(d["doc_id"]), len(toks), sum(c[t] > 0 for t in toks), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in toks))
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def op6(docs):
    out = {}
    for d in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"]))
        hits = [(i, lab) for p, lab in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        out[d["doc_id"]] = (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({lab for _, lab in hits})))
    return out


def op7(rows):
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    out = {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort(key=lambda r: r["turn"])
        loss = "".join(r["text"] or "" for r in turns if r["role"] == "assistant")
        out[c] = (len(turns), sha("".join(f"{r['role']}\n{r['text'] or ''}\n" for r in turns)), len(loss), sha(loss))
    return out


def op8_targets(docs, weights=(3, 1, 2), share=Fraction(3, 2), epochs=2):
    size = Counter()
    for d in docs:
        size[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(size.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > epochs * size[s]}
        if not full:
            return size, target | {s: float(unit * weight[s]) for s in open_}
        for s in full:
            target[s] = float(epochs * size[s])
            left -= epochs * size[s]
        open_ -= full
    return size, target


def op9(docs):
    order = sorted(docs, key=lambda d: -d["doc_id"])
    out = {}
    for d, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, u = d["text"] or "", nxt["text"] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        out[d["doc_id"]] = (len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, u)
    return out


def trigrams(text, bins=1 << 15):
    """Hashed byte trigrams, digits and space runs folded."""
    data = re.sub(rb"[\x00-\x20]+", b" ", re.sub(rb"[0-9]", b"0", text.lower().encode("utf-8", "surrogatepass")))
    return Counter((((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 17 for i in range(len(data) - 2))


def op10_model(docs, bins=1 << 15):
    """language -> trigram counts, from labelled documents."""
    model = {}
    for d in docs:
        if d["lang"] is not None and d["doc_id"] is not None:
            model.setdefault(d["lang"][:2].lower(), Counter()).update(trigrams(d["text"] or ""))
    return dict(sorted(model.items()))


def op10(rows, model, bins=1 << 15, temper=400, strength=20.0, und=1e-4):
    """rows: (id, text, declared, host, suffix) -> (language, probability, language of the text alone) for each."""
    langs = [*model, "und"]
    likely, votes = [], []
    totals = {m: sum(c.values()) + 0.5 * bins for m, c in model.items()}
    for _, text, *_ in rows:
        grams = trigrams(text)
        n = sum(grams.values())
        if not n:
            likely.append(None)
            votes.append([0.0] * len(langs))
            continue
        ll = [sum(k * math.log((c[g] + 0.5) / totals[m]) for g, k in grams.items()) * min(1.0, temper / n) for m, c in model.items()]
        ll.append(-n * math.log(bins) * min(1.0, temper / n))
        ll = [x - max(ll) for x in ll]
        likely.append(ll)
        z = sum(map(math.exp, ll))
        votes.append([math.exp(x) / z for x in ll])
    out = []
    for r, (_, _, declared, host, suffix) in enumerate(rows):
        if likely[r] is None:
            out.append(("und", 0.0, "und"))
            continue
        others = [(votes[q], x) for q, x in enumerate(rows) if q != r]
        prior = [1.0 / len(langs)] * len(langs)
        for near, weight in ((lambda x: True, float(len(langs))), (lambda x: x[4] == suffix, strength), (lambda x: x[4] == suffix and x[3] == host, strength)):
            mine = [sum(v[i] for v, x in others if near(x)) for i in range(len(langs))]
            prior = [(m + weight * p) / (sum(mine) + weight) for m, p in zip(mine, prior, strict=True)]
        post = [x + math.log(p) for x, p in zip(likely[r], prior, strict=True)]
        codes = {x[2] for x in rows if x[2]}
        if declared:
            for i in range(len(langs)):
                same, any_ = sum(v[i] for v, x in others if x[2] == declared), sum(v[i] for v, x in others if x[2])
                post[i] += math.log((same + 0.5) / (any_ + 0.5 * len(codes)))
        post[-1] += math.log(und)
        best = max(range(len(langs)), key=lambda i: post[i])
        out.append((langs[best], 1 / sum(math.exp(x - post[best]) for x in post), langs[max(range(len(langs)), key=lambda i: likely[r][i])]))
    return out
