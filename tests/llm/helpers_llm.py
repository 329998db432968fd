"""Small fixtures shared by the tests of the training-data operators."""
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"en": "the ing ter and wh ough ly ed st er".split(), "fr": "eau oi ère que ç ille eux tion ré ou".split(),
             "de": "sch ung ü ich ein ver ß en äu lich".split(), "es": "ción os ñ ar que lla ado ó en is".split()}


def sentence(rng: random.Random, lang: str = "en", words: int = 12) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def text(rng: random.Random, lang: str = "en", lines: int = 4, words: int = 12) -> str:
    return "\n".join(sentence(rng, lang, words) for _ in range(lines))


def components(nodes, links):
    """Smallest member of each node's component."""
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
