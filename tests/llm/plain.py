"""Plain versions of the operators, for small inputs."""

import re
import zlib

import numpy as np

from martflow.llm.licenses import TEMPLATES, bigrams, dice, normal

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check_pieces(rows, ids, window):
    """All ids in one piece each, in place, and hardly any padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = ids[doc][at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids[doc]))
            assert r["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += window - at
    assert padding < window and sorted(by_sequence) == list(range(len(by_sequence)))


def without_repeats(docs, width=20):
    """``{doc_id: (words, removed words, kept words)}`` of ``(doc_id, text)`` rows."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out[doc] = (len(words), sum(gone), [w for w, g in zip(words, gone, strict=True) if not g])
    return out


def shingles(text):
    words = WORD.findall(text or "")
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def grouped(nodes, linked):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def near_texts(docs, threshold=(4, 5)):
    """``{doc_id: (links, smallest id of the component)}``."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    linked = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and len(sets[a] & sets[b]) * threshold[1] >= len(sets[a] | sets[b]) * threshold[0]
    ]
    root = grouped(ids, linked)
    return {d: (sum(d in pair for pair in linked), root[d]) for d in ids}


def near_vectors(rows, threshold=0.95):
    """``{vec_id: (links, smallest id of the component)}``."""
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if good[a] @ good[b] >= threshold]
    root = grouped([i for i, _ in rows], linked)
    return {i: (sum(i in pair for pair in linked), root[i]) for i, _ in rows}


def license_of(text):
    """Best licence, coefficient and number of matching passages, by trying them all."""
    data = normal(text or "")
    lines, at = [], 0
    for line in data.split(b"\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1

    def trimmed(a, b):
        part = data[a:b]
        return a + len(part) - len(part.lstrip()), a + len(part.rstrip())

    spans, block = {trimmed(0, len(data)), *(trimmed(*s) for s in lines)}, None
    for a, b in [*lines, (len(data), len(data))]:
        if data[a:b].strip():
            block = (block[0] if block else a, b)
        elif block:
            spans.add(trimmed(*block))
            block = None
    best, n = None, 0
    for a, b in spans:
        scored = [(-dice(bigrams(data[a:b]), bigrams(normal(t))), name) for name, t in TEMPLATES.items()]
        value, name = min(scored)
        if a < b and bigrams(data[a:b]) and -value * 5 >= 4:
            n += 1
            best = min(best or (value, name), (value, name))
    return (best[1], float(-best[0]), n) if best else (None, None, 0)


def as_unigram(path):
    """A model file with the kind of its model, one number of its settings, changed."""
    data = open(path, "rb").read()
    at = data.rfind(b"\x18\x02")
    return data[: at + 1] + b"\x01" + data[at + 2 :]


def best_segments(model, text):
    """Ids by a plain search over the whole text: the best score of each prefix, of equal
    ones the longer last piece; unknown characters as bytes."""
    normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    score = {model.id_to_piece(i): (model.get_score(i), i) for i in normal}
    unknown = min(v for v, _ in score.values()) - 10
    text = ("▁" + text.replace(" ", "▁")) if text else ""
    best, last = [0.0], [None]
    for end in range(1, len(text) + 1):
        options = [(best[end - 1] + unknown, 1, None)]
        for size in range(1, min(end, 16) + 1):
            if text[end - size : end] in score:
                value, i = score[text[end - size : end]]
                options.append((best[end - size] + value, size, i))
        top = max(options)
        best.append(top[0])
        last.append(top[1:])
    out, end = [], len(text)
    while end:
        size, i = last[end]
        out += [i] if i is not None else [model.piece_to_id(f"<0x{b:02X}>") for b in reversed(text[end - 1].encode())]
        end -= size
    return out[::-1]
