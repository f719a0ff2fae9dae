"""Documents of every awkward kind, and plain forms of what operators must return."""

import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = ["id", "h", "rep", "lang", "source", "drop", "states", "piece", "block"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward(seed=1, n=60, vocabulary=12):
    """(doc_id, text): nulls, blanks, repeats, shared passages, odd white space and a very long text."""
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(vocabulary)] + ["É", "ß", "x\x1fy", "日本", "a b", "'s", "<|endoftext|>"]
    prose = lambda k: " ".join(rng.choice(some) for _ in range(k))
    base = prose(60)
    texts = [None, "", "   ", "\n\n", "one", "One", " one\t", base, base, base.replace(" ", "\t\n"), base.upper(), prose(3000)]
    texts += [texts[-1], "z " * 2000]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.4:
            ws = base.split(" ")
            for _ in range(rng.randrange(0, 6)):
                ws[rng.randrange(len(ws))] = rng.choice(some)
            texts.append(" ".join(ws))
        elif kind < 0.7:
            a = rng.randrange(0, 40)
            texts.append(prose(10) + " " + " ".join(base.split(" ")[a : a + 20]) + "\n" + prose(5))
        else:
            texts.append("\n".join(rng.choice(["Share this", " share THIS\x0b", "", prose(4)]) for _ in range(8)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 + 1, texts[k]) for i, k in enumerate(order)]


def frame(spark, rows, extra=True):
    """Documents with columns that operators also use inside, and a row without an id."""
    clash = CLASH if extra else []
    schema = "doc_id long, text string" + "".join(f", {c} string" for c in clash)
    none = [(None, "no id", *(["x"] * len(clash)))] if extra else []
    return spark.createDataFrame([(i, t, *([f"{c}{i % 3}" for c in clash])) for i, t in rows] + none, schema).repartition(3)


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
