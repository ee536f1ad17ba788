"""Small fixtures and brute force for the corpus operators."""

import random
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def classes(ids, links):
    """The smallest id that links reach, for each id."""
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


ODD_TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "Ünï cödé 🙂 é 中文", "a" * 50_000, "x " * 20_000, "\x1c\x85  z", "same text here", "same text here", "ABC abc AbC", "<|endoftext|> mid<|endoftext|>dle <|startoftext|>"]
