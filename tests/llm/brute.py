"""Plain versions of the contracts, for comparison."""

import hashlib
import re


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def luhn(value):
    total = 0
    for k, c in enumerate(reversed([int(c) for c in value if c.isdigit()])):
        total += c if k % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c)
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda v: sum(c in "0123456789" for c in v)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= digits(v) <= 19 and luhn(v)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= digits(v) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def pii_spans(texts):
    """All spans of each text by labelers written again; the counting of votes and what follows is the operator's own arithmetic."""
    import regex
    from collections import Counter

    from tarn.llm import pii as op

    number = lambda v: re.sub("[^0-9]", "", v)

    def normal(kind, v):
        if kind == "email":
            return regex.sub(r"\x20?[\[(](?:dot|DOT)[\])]\x20?", ".", regex.sub(r"\x20?[\[(](?:at|AT)[\])]\x20?", "@", v))
        return number(v) if kind == "phone" else v

    def key(kind, n):
        if kind == "name":
            m = regex.search(r"\x20(\p{Lu}\p{Ll}+)", n)
            return m[1] if m else ""
        return {"email": n.split("@")[-1].lower(), "ip": ".".join(n.split(".")[:2]), "card": number(n)[:6], "phone": n[-10:][:3], "ssn": ""}[kind]

    def listed(kind, v):
        d = number(v)
        if kind == "email":
            return 1 if regex.search(rf"(?i)[.\])\x20](?:{op.ENDINGS})$", v) else -1
        if kind == "card":
            return 1 if re.match("4|5[1-5]|2[2-7]|6|3[47]", d) else 0
        if kind == "ip":
            return 0 if re.search(r"^0+\.|\.0+$", v) else -1
        if kind == "phone":
            return 1 if re.fullmatch("1?[2-9][0-9]{2}[2-9][0-9]{6}", d) else -1
        if kind == "ssn":
            return 0 if re.search("^(?:000|666|9)|^.{3}00|0000$", d) else -1
        return 1 if re.search(rf"(?:^|\x20)(?:{op.GIVEN})(?:\x20|$)", v) else -1

    strict = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
              "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: luhn(v)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(number(v)) <= 15)}
    rows = []
    for text in texts:
        found = [(k, m, True, int(ok(m[0]))) for k, (p, ok) in strict.items() for m in re.finditer(p, text) if k != "card" or 16 <= len(number(m[0])) <= 19]
        found += [(k, m, False, -1) for k, p in op.LOOSE.items() for m in regex.finditer(p, text)]
        own = []
        for kind, m, is_strict, v1 in found:
            before, n = text[max(0, m.start() - 40) : m.start()], normal(kind, m[0])
            form = 1 if regex.search(op.FORMS[kind], n) else (-1 if kind in ("name", "phone") else 0)
            context = 0 if regex.search(op.AGAINST, before) else 1 if regex.search(op.CONTEXT[kind], before) else -1
            apart = not regex.search(r"[\p{L}0-9]$", before) and not regex.search(r"^[\p{L}0-9]", text[m.end() :][:20])
            own.append([kind, m.start(), m.end(), is_strict, [v1, form, listed(kind, m[0]), -1, context], key(kind, n), min(3, len(m[0]) // 8), apart])
        rows.append(own)
    support = Counter((c[0], c[5]) for own in rows for c in own if c[5] and (c[4][0] == 1 or c[4][4] == 1))
    for c in (c for own in rows for c in own):
        c[4][3] = 1 if support[c[0], c[5]] > 1 else -1
    counts = Counter((c[0], tuple(c[4]), c[6], c[7]) for own in rows for c in own)
    taken = op.decide([(*shape, n) for shape, n in counts.items()])
    out = []
    for own in rows:
        base = [c for c in own if c[3] and c[4][0] == 1]
        more = [c for c in own if c not in base and (c[0], tuple(c[4]), c[6], c[7]) in taken and not any(b[1] < c[2] and c[1] < b[2] for b in base)]
        out.append(",".join(f"{k}:{s}:{e}" for _, s, e, k in sorted({(op.ALL_KINDS.index(c[0]), c[1], c[2], c[0]) for c in base + more})))
    return out


def urls(pages):
    """{page_id: (words, verdict of the method, score)} of distinct ids (page_id, url, html): Viterbi and naive Bayes in plain loops."""
    import math
    from collections import Counter

    import regex

    from tarn.llm import urls as op

    def visible(html):
        return [w for w in regex.split(r"[^\p{L}]+", re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ", html or "").lower()) if w]

    counts = Counter({w: 1000 for w in {*op.LEXICON, *op.COMMON}})
    for _, _, html in pages:
        counts.update(w for w in visible(html) if 2 <= len(w) <= op.LABEL)
    whole = sum(counts.values())

    def split(name):
        best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for at in range(len(name)):
            for size in (*range(2, min(op.LABEL, len(name) - at) + 1), 1):
                w = name[at : at + size]
                gain = -math.log(whole) - math.log(10) if size == 1 else math.log(counts[w] / whole) if counts[w] else None
                if gain is not None and best[at] + gain > best[at + size]:
                    best[at + size], back[at + size] = best[at] + gain, size
        out, at = [], len(name)
        while at:
            out.append(name[at - back[at] : at])
            at -= back[at]
        joined, loose = [], False
        for w in out[::-1]:
            if len(w) == 1 and loose:
                joined[-1] += w
            else:
                joined.append(w)
            loose = len(w) == 1
        return joined

    words, tokens, bad = {}, {}, {}
    for i, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        runs = [r for r in regex.findall(r"\p{L}+|\p{N}+", re.sub(r"\.[^.]*$", "", host).lower()) if r not in op.PLAIN]
        words[i] = [w for r in runs for w in (["0"] if regex.match(r"\p{N}", r) else split(r))]
        parts = ["0" if regex.fullmatch(r"\p{N}+", x) else x for x in regex.split(r"[^\p{L}\p{N}]+", path.lower()) if x]
        tokens[i] = ["h:" + w for w in words[i]] + ["p:" + x for x in parts]
        seen = regex.split(r"[^\p{L}]+", re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ", html or "").lower())
        bad[i] = sum(w in op.LEXICON for w in seen) >= max(2.0, op.RATE * len(seen))
    own = {i: t for i, t in tokens.items() if t}
    kinds = {x for t in own.values() for x in t}
    share = {}
    for i, t in own.items():
        like = [j for j in own if sorted(own[j]) == sorted(t)]
        share[i] = sum(bad[j] for j in like) / len(like)
    seeds = {"h:" + w for w in op.LEXICON}
    score = {i: op.BEGIN + sum(x in seeds for x in t) * math.log(op.STRENGTH + 1) for i, t in own.items()}
    for _ in range(op.ROUNDS):
        p = {i: max(1 / (1 + math.exp(-score[i])), share[i]) for i in own}
        b = {x: float(op.STRENGTH) if x in seeds else 0.0 for x in kinds}
        g = dict.fromkeys(kinds, 0.0)
        for i, t in own.items():
            for x in t:
                b[x] += p[i]
                g[x] += 1 - p[i]
        prior = math.log((sum(p.values()) + 1) / (len(own) - sum(p.values()) + 1))
        nb, ng = sum(b.values()) + len(kinds) + 1, sum(g.values()) + len(kinds) + 1
        w = {x: math.log((b[x] + 1) / nb) - math.log((g[x] + 1) / ng) for x in kinds}
        score = {i: prior + sum(w[x] for x in t) for i, t in own.items()}
    return {i: (words[i], "block" if i in own and score[i] > 0 else "allow", score.get(i)) for i, _, _ in pages}
