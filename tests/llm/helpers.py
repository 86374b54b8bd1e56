"""Small corpora with every odd case, and plain versions of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, part int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def corpus(seed=1, n=60):
    """Random documents with copies, near copies, shared passages, nulls, empty, blank and one-word texts, repeated rows, a long text, null ids, sources and languages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeèoué") for _ in range(r.randint(1, 7))) for _ in range(300)]
    make = lambda k: " ".join(r.choice(vocab) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(k))
    passage = make(50)
    texts = [make(r.randint(1, 160)) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5].upper(), texts[7] + " " + passage + " x", passage + " y " + texts[9]]
    base = make(120).split(" ")
    for i in range(6):
        near = list(base)
        near[r.randrange(len(near))] = f"edit{i}"
        texts.append(" ".join(near))
    texts += [None, "", " \t\n", "one", "a b c", "a b c", "x " * 200, "1234 !!!", make(6000), "<|endoftext|> a<|startoftext|>b", "\x1c    é́ İ ſ"]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s1", "s1", "s2", "é", None]), len(t or ""), "odd", 7, 3) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, texts[4], None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)
