"""Pages with planted passages."""

import random

FUNCTION = "the a of and in to with for that by on at his her no".split()


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "n", "s"]) for _ in range(n)]


WORDS = vocabulary(2000, 11)


def prose(rng, n):
    return [rng.choice(FUNCTION) if rng.random() < 0.35 else rng.choice(WORDS) for _ in range(n)]


def prose_items(n, seed=4, size=60):
    rng = random.Random(seed)
    return [" ".join(prose(rng, size)) for _ in range(n)]


def lines(words, width=33):
    out, line = [], ""
    for w in words:
        if line and len(line) + len(w) + 1 > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def page(rng, item, words, changed, mixed, rate):
    """A page that holds ``words`` words of the item with ``changed`` of them replaced, columns read across if ``mixed``."""
    a = rng.randrange(len(item) - words + 1)
    part = item[a : a + words]
    for x in rng.sample(range(1, words - 1), changed):
        part[x] = rng.choice([w for w in WORDS if w != part[x] and len(w) > 3])
    shown = lines(part)
    if mixed:
        shown = [x for both in zip(shown, lines(prose(rng, 150))) for x in both]
    body = lines(prose(rng, 180))
    at = rng.randrange(len(body))
    text = "\n".join(body[:at] + shown + body[at:])
    return "".join(rng.choice("abcdefghilmnorstu") if c.isalpha() and rng.random() < rate else c for c in text)
