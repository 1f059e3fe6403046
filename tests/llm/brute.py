"""Plain versions of the operators, one text after the other, and awkward tables."""

import hashlib
import random
import re

from pyspark.sql import types as T

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
    r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

# Columns of documents, and two whose names the operators use themselves.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("row", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("spans", T.StringType()),
    T.StructField("node", T.LongType()),
])


def documents(spark, texts, sources=None, langs=None, ids=None):
    rows = []
    for i, text in enumerate(texts):
        rows.append((
            ids[i] if ids else i, text, langs[i] if langs else "en", sources[i] if sources else "s",
            None if text is None else len(text), "r", 5, "x", 1,
        ))
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def awkward_texts():
    """Null, empty, blank, short, long, repeated and odd texts."""
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        None, "", "   \t\n", "a", "A b", "one two three", "ONE two\x0bthree", "one two three", "x" * 100_000, long_, long_ + " end",
        "é È naïve \U0001F600 text", "1.2.3.4 and 1.2.3", "\x00\x1c\x7f", "'s 't don't", "<|endoftext|> token=abcdefgh12",
    ]


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        value = int(c) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


PERSONAL = [
    ("email", EMAIL, lambda m: True),
    ("ip", IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    ("card", CARD, lambda m: 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
    ("phone", PHONE, lambda m: 9 <= len(digits(m.group())) <= 15),
]
SECRETS = [
    ("assign", ASSIGN, lambda m: len(m.group(1)) >= 8),
    ("access", ACCESS, lambda m: len(m.group()) >= 16),
    ("hex", HEX, lambda m: len(m.group()) >= 32),
]


def spans(text, kinds):
    """(counts by kind, sha256, description) of the base spans of a text."""
    found = sorted(
        (m.start(), order, m.end(), name)
        for order, (name, pattern, keep) in enumerate(kinds)
        for m in pattern.finditer(text or "") if keep(m)
    )
    told = ",".join(f"{name}:{start}:{end}" for start, _, end, name in found)
    counts = [sum(f[3] == name for f in found) for name, _, _ in kinds]
    return counts, hashlib.sha256(told.encode()).hexdigest(), told


def noise(pieces, n, most, seed):
    """Random texts put together from pieces."""
    draw = random.Random(seed)
    return ["".join(draw.choice(pieces) for _ in range(draw.randrange(most))) for _ in range(n)]


def shingles(text, width=3):
    words = SPACED.findall((text or "").translate(ASCII_LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(width)], strict=False))


def near_duplicates(ids, texts, percent=85, width=3):
    """(doc_id, n_shingles, component_id, kept) for documents with distinct ids."""
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)], least[find(i)] == doc) for i, doc in enumerate(ids))


def contamination(texts, items, window=10):
    """(n_words, n_hit, sorted items) of each text."""
    phrases = {}
    for item, text in items:
        words = ALNUM.findall((text or "").translate(ASCII_LOWER))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            phrases.setdefault(tuple(words[i:i + n]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for text in texts:
        words = ALNUM.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                owners = phrases.get(tuple(words[i:i + n]))
                if owners is not None:
                    hit.update(range(i, i + n))
                    found |= owners
        out.append((len(words), len(hit), sorted(str(f) for f in found if f is not None)))
    return out
