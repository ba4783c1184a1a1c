"""Brute-force versions and small hostile tables."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, rid string, size string, bucket string, shard string"


def documents(seed=3):
    """Nulls, blanks, short and very long texts, copies, near copies, repeated rows, shared passages, odd letters."""
    rng = random.Random(seed)
    words = ["the", "of", "ring", "stone", "ÄpfeL", "naïve", "water", "sun", "Ñandú", "light", "road", "tree", "x", "go.", "why?", "日本"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, passage = make(120), make(60)
    near = base.split()
    near[50] = "changed"
    far = base.split()
    for k in range(0, 120, 4):
        far[k] = f"other{k}"
    texts = [None, "", "   \n\t ", "one", "one two", "One TWO", "one two three four", "one two three four five", base, base, " ".join(near), " ".join(far), base.upper()]
    texts += [make(40) + "\n" + passage + "\n" + make(30), make(20) + "\n" + passage, "of " * 400, "of " * 300, make(30_000), "a" * 700, "b" + "a" * 700, "é" * 80, "aé" + "é" * 79]
    texts += [make(rng.randrange(1, 200)) for _ in range(20)]
    rows = [(k * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "z", None]), len(t) if t is not None else None) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, "en", "s1", len(base)), (None, None, None, None, None), (7, "a second text under an id that is taken, " + passage, "en", "z", 9)]
    rng.shuffle(rows)
    return [(*r, "b", "r", "z", "k", "s") for r in rows]


def frame(spark, rows, tmp_path, name="documents", schema=SCHEMA, files=3):
    """Read from files, as tables are."""
    path = f"file://{tmp_path}/{name}.parquet"
    spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows):
    """{doc_id: smallest reachable}, links by Jaccard of shingles; rows: (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if x and y and 100 * common >= 75 * (len(x) + len(y) - common):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {d: find(d) for d in up}


def cut(rows, width=50):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] as sorted tuples."""
    out = []
    for d, t in rows:
        own = (t or "").encode()
        gone = [False] * len(own)
        if d is not None:
            seen = {o[i : i + width] for e, u in rows if e is not None and e < d and u for o in [u.encode()] for i in range(len(o) - width + 1)}
            for i in range(len(own) - width + 1):
                if own[i : i + width] in seen:
                    gone[i : i + width] = [True] * width
        kept = bytes(b for b, g in zip(own, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(own), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) if x is not None else (False, 0) for x in row)
