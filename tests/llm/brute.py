"""Plain single-machine versions of the operators' contracts, written apart from them."""

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def base(text):
    text = text or ""
    words = WORD.findall(text)
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
        "n_repeat_words": len(hit), "base_failed": n < 50 or 100 * len(hit) > 50 * n,
    }


def secret_spans(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            spans.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            spans.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(spans)]


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def near(rows, width=4, percent=80):
    sets = [(d, shingles(t, width)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(s), top(d)) for d, s in sets}


def suffix(rows, length=100):
    """rows: (doc_id, text) in order of precedence."""
    seen, out = set(), {}
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            win = raw[i : i + length]
            if win in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(win)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(raw), sum(gone), runs, sha(kept))
    return out


def windows13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def contaminated(docs, items):
    wins = {}
    for item, text in items:
        w = windows13(text)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = {}
    for d, text in docs:
        w = windows13(text)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if items_here := wins.get(tuple(w[p : p + n])):
                    found |= items_here
                    hit |= set(range(p, p + n))
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def unigram(word, pieces, byte):
    """Fewest tokens of the best-scored segmentation, over all ends and starts."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + byte * width, best[end - 1][1] + width)]
        for start in range(max(0, end - 20), end):
            if word[start:end] in pieces:
                ways.append((best[start][0] + pieces[word[start:end]], best[start][1] + 1))
        best.append(min(ways, key=lambda x: (-x[0], x[1])))
    return best[-1][1]


class _Tree(HTMLParser):
    """Elements as [tag, class, parts], parts being text or elements; for well-formed pages."""

    def __init__(self, page):
        super().__init__()
        self.root = ["#page", "", []]
        self.path = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class") or "", []]
        self.path[-1][2].append(node)
        self.path.append(node)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        self.path[-1][2].append(data)


def main_text(page):
    """Tree scoring by its definition: every element's score from a walk over all that it holds."""
    tree, blocks, nodes = _Tree(page).root, [], []
    doubtful = lambda node: node[1] == "share" and node[0] != "form"

    def walk(node, above, in_link):
        own = node[0] not in ("a",)
        if node[0] == "nav" or "comments" in node[1]:
            node = [node[0], node[1], []]
        if own:
            above = [*above, node]
            nodes.append((node, above))
            blocks.append((above, []))
        for part in node[2]:
            if isinstance(part, str):
                blocks[-1][1].append((part, in_link))
            else:
                walk(part, above, in_link or part[0] == "a")
                if part[0] != "a":
                    blocks.append((above, []))

    walk(tree, [], False)
    found = []
    for above, parts in blocks:
        text = " ".join("".join(x for x, _ in parts).split())
        if text:
            found.append((above, text, min(sum(len(x.strip()) for x, linked in parts if linked), len(text))))
    inside = lambda node, above: any(x is node for x in above)
    held = lambda node: sum(len(t) for above, t, _ in found if inside(node, above))
    forms = [node for node, _ in nodes if node[0] == "form" and held(node) < held(tree) / 2]
    out = lambda above: any(inside(f, above) for f in forms)
    found = [x for x in found if not out(x[0])]
    prior = {"article": 25, "main": 20, "section": 3, "div": 3, "td": 2, "ul": -3}

    def score(node):
        points, any_paragraph = 0.0, False
        for above, text, _ in found:
            if len(text) < 25 or above[-1][0] == "h2":
                continue
            chain = above[:-1] if above[-1][0] in ("p", "pre", "td") else above
            for steps, x in enumerate(chain[::-1][:4]):
                if x is node:
                    points += (1 + text.count(",") + min(len(text) / 100, 3)) / 2**steps
                    any_paragraph = True
        if not any_paragraph:
            return 0.0
        return (points + prior.get(node[0], 0) - 25 * doubtful(node)) * (1 - density(node))

    def density(node):
        chars = sum(len(t) for above, t, _ in found if inside(node, above))
        return sum(n for above, _, n in found if inside(node, above)) / chars if chars else 0.0

    scores = [score(node) for node, _ in nodes]
    scored = [k for k, (node, _) in enumerate(nodes) if any(len(t) >= 25 and above[-1][0] != "h2" for above, t, _ in found)]
    best = nodes[max(range(len(nodes)), key=lambda k: (scores[k], -k))] if scored else nodes[0]
    for node, above in nodes:
        if node[0] in ("article", "main") and inside(node, best[1]):
            best = (node, above)
            break
    top = score(best[0])

    def stays(above):
        if inside(best[0], above):
            below = [x for x in above if not inside(x, best[1])]
            return all(not doubtful(x) or score(x) > 0 for x in below)
        if len(best[1]) < 2 or not inside(best[1][-2], above) or above[-1] is best[1][-2]:
            return False
        side = above[[x is best[1][-2] for x in above].index(True) + 1 :]
        first, chars = side[0], sum(len(t) for a, t, _ in found if inside(side[0], a))
        if doubtful(first) or any(doubtful(x) and score(x) <= 0 for x in side[1:]):
            return False
        paragraph = first[0] in ("p", "pre", "td") and (chars > 80 and density(first) < 0.25 or 0 < chars and density(first) == 0)
        return score(first) >= max(10, 0.2 * top) or paragraph or first[0] == "h2" and density(first) < 0.33

    return "\n".join(text for above, text, _ in found if stays(above))
