"""The operators once more, the plain way, over a few rows in one process."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").encode().lower().decode()


def shingles(text, k):
    words = WORD.findall(lowered(text))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_groups(docs, k, percent):
    """id -> (n_shingles, component)."""
    sets = {d: shingles(t, k) for d, t in docs}
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


KINDS = [
    ("assign", re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
MADE_UP = re.compile("(?i)example|sample|dummy|changeme|placeholder|your_|xxxx|1234567890|0000000|abcdefgh")


ADDED = ["live", "copied", "unlikely"]


def secrets(docs, many_owners=3, many_repos=5):
    """Rows of (doc_id, owner, repo, text) -> list of (doc_id, base spans, added spans)."""
    found, places = [], defaultdict(dict)
    for doc, owner, repo, text in docs:
        place = (owner is not None, owner or "", repo is not None, repo or "")
        spans = []
        for at, (kind, pattern, group, least) in enumerate(KINDS):
            for m in pattern.finditer(text or ""):
                if len(m[group]) >= least:
                    spans.append((m.start(), at, kind, m.end(), m[group]))
                    places[m[group]][text] = min(place, places[m[group]].get(text, place))
        found.append((doc, sorted(spans)))

    def verdict(value):
        real = len(set(value)) >= 6 and re.search("[0-9]", value) and not MADE_UP.search(value)
        repos = set(places[value].values())
        owners = {p[:2] for p in repos}
        if len(owners) >= many_owners or len(owners) > 1 and len(repos) >= many_repos:
            return "copied"
        return "live" if real else "unlikely"

    out = []
    for doc, spans in found:
        added = {(e - len(v), 3 + ADDED.index(verdict(v)), verdict(v), e) for _, _, _, e, v in spans}
        out.append((doc, [s[:4] for s in spans], sorted(added)))
    return out


def said(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def masked(text, added, mask="<secret>"):
    runs = []
    for start, _, kind, end in added:
        if kind == "live":
            if runs and start < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
    for start, end in reversed(runs):
        text = text[:start] + mask + text[end:]
    return text


def line_dedup(docs, percent=80):
    """(doc_id, text) in any order -> {doc_id: text left}."""
    lines = []
    for doc, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            words = set(WORD.findall(line))
            if words:
                lines.append((doc, i, words))
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for j, (doc, i, words) in enumerate(lines):
        for _, _, other in lines[:j]:
            common = len(words & other)
            if common * 100 >= len(words | other) * percent:
                gone.add((doc, i))
                break
    return {
        doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone)
        for doc, text in docs
    }


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall("[#*$%&|<>]", text)),
        sum(n - 1 for n in lines.values()),
        len(inside),
    )


def normal(line):
    return " ".join(WORD.findall(lowered(line)))


def quality(docs, least=3, share=10, lost_percent=50, min_words=50):
    """Rows of (doc_id, host, text) -> list of (doc_id, counts, base_failed, kept, lost, cleaned text)."""
    texts = defaultdict(set)
    for _, host, text in docs:
        texts[host].add(text)
    seen = Counter((host, x) for host, own in texts.items() for t in own for x in {normal(y) for y in (t or "").split("\n")} if x)
    often = {(h, x) for (h, x), n in seen.items() if n >= least and n * 100 > len(texts[h]) * share}
    out = []
    for doc, host, text in docs:
        c = counts(text)
        lines = (text or "").split("\n")
        lost = sum(len(WORD.findall(x)) for x in lines if (host, normal(x)) in often)
        failed = c[0] < min_words or 100 * c[4] > 50 * c[0]
        kept = not failed and 100 * lost <= lost_percent * c[0]
        cleaned = "\n".join(x for x in lines if (host, normal(x)) not in often)
        out.append((doc, c, failed, kept, lost, cleaned))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
