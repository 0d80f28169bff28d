"""Query trees evaluated row by row in plain Python: what the compiler is held against."""

from __future__ import annotations

import math
import re

from plumbline.plans import nodes as N


def words(text: str) -> list[str]:
    out = [re.sub(r"^[^\w]+|[^\w]+$", "", p.replace("_", "-")) for p in text.lower().split()]
    return [w for w in out if w]


def bm25(docs, field, tokens, op):
    toks = {d["external_id"]: words(d[field]) for d in docs if d.get(field) is not None}
    n = len(toks)
    if not tokens or not n:
        return {}
    avg = sum(map(len, toks.values())) / n
    out = {}
    for i, t in toks.items():
        parts = []
        for q in tokens:
            tf = t.count(q)
            df = sum(q in x for x in toks.values())
            idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
            parts.append(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg)) if tf else None)
        if all(p is not None for p in parts) if op == "and" else any(p is not None for p in parts):
            out[i] = sum(p or 0.0 for p in parts)
    return out


def knn(docs, node, allowed=None):
    def near(v):
        a, b = math.sqrt(sum(x * x for x in v)), math.sqrt(sum(x * x for x in node.vector))
        return sum(x * y for x, y in zip(v, node.vector)) / (a * b) - 1 if a * b else -1.0

    have = [(-near(d[node.field]), d["external_id"]) for d in docs if d.get(node.field) is not None and (allowed is None or d["external_id"] in allowed)]
    return {i: -s for s, i in sorted(have)[: node.k]}


def run(node, docs):
    """{external_id: score} of the hits."""
    every = {d["external_id"] for d in docs}
    values = lambda d, f: [] if d.get(f) is None else d[f] if isinstance(d[f], list) else [d[f]]
    pick = lambda p: {d["external_id"]: 1.0 for d in docs if p(d)}
    if isinstance(node, N.Term):
        return pick(lambda d: node.value in values(d, node.field))
    if isinstance(node, N.Terms):
        return pick(lambda d: set(node.values) & set(values(d, node.field)))
    if isinstance(node, N.Prefix):
        return pick(lambda d: (d.get(node.field) or "").startswith(node.value))
    if isinstance(node, N.Ids):
        return pick(lambda d: d["external_id"] in node.values)
    if isinstance(node, N.Exists):
        return pick(lambda d: values(d, node.field))
    if isinstance(node, N.Range):

        def inside(d):
            v = d.get(node.field)
            if v is None:
                return False
            low = v >= node.gte if node.gte is not None else node.gt is None or v > node.gt
            return low and (v <= node.lte if node.lte is not None else node.lt is None or v < node.lt)

        return pick(inside)
    if isinstance(node, N.Duplicated):
        held = [v for d in docs for v in set(values(d, node.field))]
        return pick(lambda d: any(held.count(v) >= max(2, node.min_group_size) for v in values(d, node.field)))
    if isinstance(node, N.Match):
        return bm25(docs, node.field, words(node.text), node.op)
    if isinstance(node, N.Knn):
        return knn(docs, node)
    if isinstance(node, N.Not):
        inner = run(node.clause, docs)
        return {i: 1.0 for i in every if i not in inner}
    if isinstance(node, N.Or):
        out = {}
        for c in node.clauses:
            for i, s in run(c, docs).items():
                out[i] = out.get(i, 0.0) + s
        return out
    if isinstance(node, N.And):
        near = [c for c in node.clauses if isinstance(c, N.Knn)]
        rest = [c for c in node.clauses if not isinstance(c, N.Knn)]
        found = None
        if rest:
            legs = [run(c, docs) for c in rest]
            found = {i: sum(leg[i] for leg in legs) for i in every if all(i in leg for leg in legs)}
            if all(isinstance(c, N.Not) for c in rest):
                found = {i: s + 1.0 for i, s in found.items()}
        for c in near:
            leg = knn(docs, c, None if not rest else set(run_rest(rest, docs)))
            found = leg if found is None else {i: found[i] + s for i, s in leg.items() if i in found}
        return found or {}
    if isinstance(node, N.Rrf):
        out = {}
        for q in node.queries:
            ranked = sorted(run(q, docs).items(), key=lambda x: (-round(x[1], 9), x[0]))
            for r, (i, _) in enumerate(ranked, 1):
                out[i] = out.get(i, 0.0) + 1 / (max(node.k, 1) + r)
        return out
    raise TypeError(node)


def run_rest(rest, docs):
    return run(N.And(tuple(rest)), docs)
