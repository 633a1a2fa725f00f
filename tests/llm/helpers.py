"""Documents with every odd case, and plain versions of the operators to hold the real ones against."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rank string, slot string, score string, _pid int"


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, repeated rows and columns with clashing names."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = say(60), say(14)
    texts: list[str | None] = [None, "", " \t\r\n", "one", "one two three four", "A b c\x1cd", "\n\n", "x" * 300]
    for k in range(n):
        t = say(r.choice([3, 20, 80, 200]))
        if k % 5 == 0:
            t += "\n" + line + "  \n" + say(4)
        if k % 7 == 0:
            t += " " + passage + " " + say(6)
        texts.append(t)
    base = say(300)
    for k in range(30):  # near copies of one text
        w = base.split()
        for _ in range(k % 5):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w).upper() if k % 3 == 0 else " ".join(w))
    texts += [texts[10]] * 12 + ["Oneaea " * 400, say(4000)]
    rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 4}", len(t or ""), 1, "r", "s", "x", 3) for k, t in enumerate(texts)]
    return rows


def frame(spark, rows, parts: int = 5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def words(text: str | None) -> list[str]:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
